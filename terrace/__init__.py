"""terrace: raw tables down to one number and back up again, as Spark plans."""

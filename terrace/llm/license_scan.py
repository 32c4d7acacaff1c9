"""License scans by sentence rules: sentences become identifiers, identifier sequences match ordered licence rules.

Text is cut into sentences and normalised; a sentence that holds a known licence sentence is replaced by its
identifier, any other that speaks of a licence by UNKNOWN. Rules are tried in order on the document's sequence of
identifiers; a rule that matches takes its identifiers away, so that parts of a long licence aren't reported again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences from the public licence texts and their usual notices, normalised (lower case, words and
#: single spaces, no full stop at a word's end); where one sentence holds several, the first of the list counts.
_SENTENCES = """
Apache20ref: licensed under the apache license version 2.0
Apache20ref: released under the apache license version 2.0
Apache20ref: distributed under the apache license version 2.0
Apache20ref: licensed under the apache 2.0 license
Apache20ref: licensed under apache 2.0
Apache11ref: apache software license version 1.1
ApacheCopy: you may obtain a copy of the license at
ApacheUse: you may not use this file except in compliance with the license
ApacheAsIs: software distributed under the license is distributed on an as is basis
ApacheSee: see the license for the specific language governing permissions and limitations under the license
MIT0grant: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
MITgrant: permission is hereby granted free of charge to any person obtaining a copy
MITnotice: the above copyright notice and this permission notice shall be included in all copies
MITasis: the software is provided as is without warranty of any kind
MITevil: the software shall be used for good not evil
MITref: released under the mit license
MITref: licensed under the mit license
MITref: distributed under the mit license
MITref: licensed under the terms of the mit license
MITref: use of this source code is governed by an mit style license
NCSAref: university of illinois ncsa open source license
ISCref: licensed under the isc license
ISCgrant: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0BSDgrant: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
PostgreSQLgrant: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
HPNDgrant: permission to use copy modify and distribute this software and its documentation for any purpose
AGPL3later: gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
LGPL3later: gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
LGPL21later: gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version
LGPL20later: gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
GPL3later: gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
GPL2later: gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
GPL3only: gnu general public license as published by the free software foundation version 3
GPL2only: gnu general public license version 2 as published by the free software foundation
GPL2only: gnu general public license as published by the free software foundation version 2
GFDLref: gnu free documentation license
AGPL3ref: gnu affero general public license version 3
AGPL3ref: licensed under the agpl 3.0
LGPL3ref: gnu lesser general public license version 3
LGPL21ref: gnu lesser general public license version 2.1
LGPL20ref: gnu library general public license version 2
GPL3ref: licensed under the gnu general public license version 3
GPL3ref: released under the gnu general public license version 3
GPL3ref: gnu general public license v3.0
GPL3ref: licensed under the gpl v3
GPL2ref: licensed under the gnu general public license version 2
GPL2ref: released under the gnu general public license version 2
GPL2ref: gnu general public license v2.0
GPL2ref: licensed under the gpl v2
AGPLfree: you can redistribute it and or modify it under the terms of the gnu affero general public license
LGPLfree: you can redistribute it and or modify it under the terms of the gnu lesser general public license
GPLfree: you can redistribute it and or modify it under the terms of the gnu general public license
GPLv3later: either version 3 of the license or at your option any later version
GPLv21later: either version 2.1 of the license or at your option any later version
GPLv2later: either version 2 of the license or at your option any later version
GPLwarranty: distributed in the hope that it will be useful but without any warranty
GPLsee: see the gnu general public license for more details
GPLsee: see the gnu lesser general public license for more details
GPLsee: see the gnu affero general public license for more details
GPLcopy: you should have received a copy of the gnu general public license
GPLcopy: you should have received a copy of the gnu lesser general public license
GPLcopy: you should have received a copy of the gnu affero general public license
BSDredist: redistribution and use in source and binary forms with or without modification are permitted
BSDsource: redistributions of source code must retain the above copyright notice
BSDbinary: redistributions in binary form must reproduce the above copyright notice
BSDadvert: all advertising materials mentioning features or use of this software must display the following acknowledgement
BSDname: neither the name of
BSDasis: this software is provided by the copyright holders and contributors as is
BSDasis: this software is provided by the regents and contributors as is
BSD3ref: licensed under the bsd 3 clause license
BSD2ref: licensed under the bsd 2 clause license
BSD3ref: use of this source code is governed by a bsd style license
MPL20ref: this source code form is subject to the terms of the mozilla public license v 2.0
MPL20ref: subject to the terms of the mozilla public license v 2.0
MPL20ref: licensed under the mozilla public license version 2.0
MPL11ref: subject to the mozilla public license version 1.1
EPL20ref: eclipse public license v 2.0
EPL20ref: eclipse public license 2.0
EPL10ref: eclipse public license v1.0
EPL10ref: eclipse public license version 1.0
CDDL10ref: common development and distribution license version 1.0
CDDL10ref: subject to the terms of the common development and distribution license
CPL10ref: common public license version 1.0
EUPL12ref: european union public licence version 1.2
EUPL12ref: licensed under the eupl version 1.2
EUPL12ref: licensed under the eupl 1.2
CECILL21ref: cecill free software license agreement version 2.1
CECILLref: governed by the cecill license under french law
BSL10ref: distributed under the boost software license version 1.0
BSL10ref: boost software license version 1.0
Zlibgrant: permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
Zliborigin: the origin of this software must not be misrepresented
Zlibaltered: altered source versions must be plainly marked as such
Zlibnotice: this notice may not be removed or altered from any source distribution
Artistic20ref: licensed under the artistic license 2.0
Artistic20ref: artistic license version 2.0
WTFPLref: do what the fuck you want to public license
MSPLref: microsoft public license ms pl
MSRLref: microsoft reciprocal license ms rl
OFL11ref: licensed under the sil open font license version 1.1
PSF2ref: python software foundation license version 2
PHP301ref: subject to version 3.01 of the php license
Rubyref: licensed under the ruby license
UPL10ref: universal permissive license v 1.0
UPL10ref: universal permissive license version 1.0
BlueOakref: blue oak model license 1.0.0
OpenSSLref: this product includes software developed by the openssl project
Sleepycatref: redistributions in any form must be accompanied by information on how to obtain complete source code
Beerware: as long as you retain this notice you can do whatever you want with this stuff
Elastic20ref: licensed under the elastic license 2.0
Elastic20ref: subject to the elastic license 2.0
SSPL1ref: server side public license version 1
BUSL11ref: business source license 1.1
AFL30ref: licensed under the academic free license version 3.0
OSL30ref: licensed under the open software license version 3.0
ODbLref: made available under the open database license
ODCByref: made available under the open data commons attribution license
PDDLref: made available under the public domain dedication and license
W3Cref: w3c software notice and license
CC0ref: cc0 1.0 universal
CC0ref: licensed under cc0 1.0
CC0ref: to the extent possible under law the author has waived all copyright and related or neighboring rights
Unlicense: free and unencumbered software released into the public domain
PublicDomain: this work is in the public domain
PublicDomain: placed in the public domain
AllRights: all rights reserved
"""
#: Licence rules as (licence, identifiers in order), longer texts before what they contain.
_RULES = """
Apache-2.0: Apache20ref ApacheUse ApacheCopy ApacheAsIs ApacheSee
Apache-2.0: Apache20ref ApacheUse ApacheCopy
Apache-2.0: Apache20ref
Apache-1.1: Apache11ref
JSON: MIT0grant MITnotice MITevil MITasis
JSON: MITgrant MITnotice MITevil MITasis
MIT: MIT0grant MITnotice MITasis
MIT: MITgrant MITnotice MITasis
MIT: MIT0grant MITnotice
MIT: MITgrant MITnotice
MIT-0: MIT0grant MITasis
NCSA: NCSAref
MIT: MITref
ISC: ISCgrant MITasis
ISC: ISCgrant
ISC: ISCref
0BSD: 0BSDgrant
PostgreSQL: PostgreSQLgrant
HPND: HPNDgrant
BSD-4-Clause: BSDredist BSDsource BSDbinary BSDadvert BSDname BSDasis
BSD-4-Clause: BSDredist BSDsource BSDbinary BSDadvert BSDname
BSD-3-Clause: BSDredist BSDsource BSDbinary BSDname BSDasis
BSD-3-Clause: BSDredist BSDsource BSDbinary BSDname
Sleepycat: BSDredist BSDsource BSDbinary Sleepycatref
BSD-2-Clause: BSDredist BSDsource BSDbinary BSDasis
BSD-2-Clause: BSDredist BSDsource BSDbinary
BSD-3-Clause: BSD3ref
BSD-2-Clause: BSD2ref
AGPL-3.0-or-later: AGPL3later GPLwarranty GPLsee GPLcopy
AGPL-3.0-or-later: AGPL3later
AGPL-3.0-or-later: AGPLfree GPLv3later
LGPL-3.0-or-later: LGPL3later GPLwarranty GPLsee GPLcopy
LGPL-3.0-or-later: LGPL3later
LGPL-2.1-or-later: LGPL21later GPLwarranty GPLsee GPLcopy
LGPL-2.1-or-later: LGPL21later
LGPL-2.0-or-later: LGPL20later
GPL-3.0-or-later: GPL3later GPLwarranty GPLsee GPLcopy
GPL-3.0-or-later: GPL3later
GPL-2.0-or-later: GPL2later GPLwarranty GPLsee GPLcopy
GPL-2.0-or-later: GPL2later
GPL-3.0-or-later: GPLfree GPLv3later GPLwarranty GPLsee GPLcopy
GPL-3.0-or-later: GPLfree GPLv3later
GPL-2.0-or-later: GPLfree GPLv2later GPLwarranty GPLsee GPLcopy
GPL-2.0-or-later: GPLfree GPLv2later
LGPL-3.0-or-later: LGPLfree GPLv3later
LGPL-2.1-or-later: LGPLfree GPLv21later
LGPL-2.0-or-later: LGPLfree GPLv2later
GPL-3.0: GPL3only
GPL-2.0: GPL2only
LGPL-3.0: LGPL3ref
LGPL-2.1: LGPL21ref
LGPL-2.0: LGPL20ref
AGPL-3.0: AGPL3ref
GPL-3.0: GPL3ref
GPL-2.0: GPL2ref
GFDL: GFDLref
MPL-2.0: MPL20ref
MPL-1.1: MPL11ref
EPL-2.0: EPL20ref
EPL-1.0: EPL10ref
CDDL-1.0: CDDL10ref
CPL-1.0: CPL10ref
EUPL-1.2: EUPL12ref
CECILL-2.1: CECILL21ref
CECILL: CECILLref
BSL-1.0: BSL10ref
Zlib: Zlibgrant Zliborigin Zlibaltered Zlibnotice
Zlib: Zlibgrant
Artistic-2.0: Artistic20ref
WTFPL: WTFPLref
MS-PL: MSPLref
MS-RL: MSRLref
OFL-1.1: OFL11ref
PSF-2.0: PSF2ref
PHP-3.01: PHP301ref
Ruby: Rubyref
UPL-1.0: UPL10ref
BlueOak-1.0.0: BlueOakref
OpenSSL: OpenSSLref
Beerware: Beerware
Elastic-2.0: Elastic20ref
SSPL-1.0: SSPL1ref
BUSL-1.1: BUSL11ref
AFL-3.0: AFL30ref
OSL-3.0: OSL30ref
ODbL-1.0: ODbLref
ODC-By-1.0: ODCByref
PDDL-1.0: PDDLref
W3C: W3Cref
CC0-1.0: CC0ref
Unlicense: Unlicense
Public-Domain: PublicDomain
"""
#: Kinds of Creative Commons licences: short and long name; each comes in these versions and wordings.
_CC_KINDS = (("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"), ("by nc", "attribution noncommercial"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by", "attribution"))
_CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0")


def _known() -> tuple[tuple[tuple[str, str], ...], tuple[tuple[str, tuple[str, ...]], ...]]:
    """The tables of sentences and rules, with the Creative Commons licences before the last, most general entries."""
    sentences = [tuple(line.split(": ", 1)) for line in _SENTENCES.strip().splitlines()]
    rules = [(name, tuple(ids.split())) for name, ids in (line.split(": ", 1) for line in _RULES.strip().splitlines())]
    commons = []
    for short, long in _CC_KINDS:
        for version in _CC_VERSIONS:
            key = f"CC{short.replace(' ', '').upper()}{version.replace('.', '')}ref"
            commons += [(key, f"cc {short} {version}"), (key, f"creative commons {long} {version}"), (key, f"creative commons {long} license version {version}")]
            rules.append((f"CC-{short.replace(' ', '-').upper()}-{version}", (key,)))
    return (*commons, *sentences), (*rules, ("Proprietary", ("AllRights",)))


SENTENCES, RULES = _known()
#: Every known sentence holds one of these words; other documents and sentences need no further look.
TRIGGER = "(?iu)licen[cs]|permi[st]|reserved|redistribut|copyright|cc0|cc by|domain|commons|agpl|gpl|eupl|misrepresented|neither|plainly marked|retain this|openssl|advertising|removed or altered|good not evil|warranty|software is provided"
#: The trigger on raw text, where anything but letters and digits may stand between two words.
_WORDS = TRIGGER.replace(" ", r"[^\p{L}\p{N}]+")
#: For each alternative of the trigger the words that a text must hold for it, up to their first character class.
_HOLDS = [[word.split("[")[0] for word in one.split(" ")] for one in TRIGGER.removeprefix("(?iu)").split("|")]
_SPEAKS = r"\blicen[cs]ed?\b"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text: cut after ``.``, ``!``, ``?`` or ``;`` before white space (but not in ``v. 2.0``), and at blank lines; links go."""
    cut = F.split(F.regexp_replace(text, r"https?://\S+", " "), r"(?<=[.!?;])(?<!\b[vV]\.)\s+|\n\s*\n")
    clean = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}.]+", " "), r"\.+(?=\s|$)", "")))
    return F.filter(clean, lambda s: s != "")


def identifiers(found: Column, known: tuple = SENTENCES) -> Column:
    """The sequence of licence-sentence identifiers in an array of sentences; the first known sentence that one holds counts."""
    table = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(f" {phrase} ").alias("phrase")) for key, phrase in known])
    padded = F.transform(F.filter(found, lambda s: s.rlike(TRIGGER)), lambda s: F.concat(F.lit(" "), s, F.lit(" ")))

    def of(s: Column) -> Column:
        first = F.get(F.filter(table, lambda k: s.contains(k["phrase"])), F.lit(0))["key"]
        return F.coalesce(first, F.when(s.rlike(_SPEAKS), "UNKNOWN"))

    return F.filter(F.transform(padded, of), lambda x: x.isNotNull())


def apply_rules(sequence: Column, rules: tuple = RULES) -> Column:
    """(rest, found): licences of the rules that match a sequence, in rule order, and the identifiers that none used."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in rules])
    joined = F.array_join(F.transform(sequence, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    start = F.struct(joined.alias("rest"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(
        table,
        start,
        lambda a, r: F.when(
            a["rest"].contains(r["ids"]), F.struct(F.replace(a["rest"], r["ids"], F.lit("")).alias("rest"), F.array_append(a["found"], r["name"]).alias("found"))
        ).otherwise(a),
    )


def scan(docs: DataFrame, known: tuple = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """(doc_id, licenses, sentence_ids, n_unmatched): for every document its licences, sorted and distinct.

    sentence_ids is the sequence found; n_unmatched counts its members that no rule used. Null and empty texts have
    none; every row gives one row, whatever its id, so an empty table gives none; other columns are left out.
    """
    # A search for plain words in the lower-cased text spares most texts the pattern, which is many times as slow.
    maybe = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col("_low").contains(word) for word in words]) for words in _HOLDS])
    own = docs.select("doc_id", "text", F.lower("text").alias("_low"))
    ids = F.when(maybe & F.col("text").rlike(_WORDS), identifiers(sentences(F.col("text")), known)).otherwise(F.array().cast("array<string>"))
    found = own.select("doc_id", F.coalesce(ids, F.array().cast("array<string>")).alias("sentence_ids"))
    ruled = found.withColumn("r", F.when(F.size("sentence_ids") > 0, apply_rules(F.col("sentence_ids"), rules)))
    return ruled.select(
        "doc_id", F.coalesce(F.array_sort(F.array_distinct("r.found")), F.array().cast("array<string>")).alias("licenses"), "sentence_ids",
        F.coalesce(F.length("r.rest") - F.length(F.replace("r.rest", F.lit("<"), F.lit(""))), F.lit(0)).cast("long").alias("n_unmatched"),
    )

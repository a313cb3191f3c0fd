"""Signature rules of licenses, in order of priority within each class.

A line holds: class, label, keyword, pattern. A space in a pattern stands for any short run of white
space and comment or punctuation characters. A rule is only tried on texts that hold its keyword.
Classes: 1 license tags and full-text clauses, 2 grants, 3 names, 4 hints without a named license.
"""

from __future__ import annotations

import re
from functools import lru_cache

RULES = r"""
1 mit spdx spdx license identifier mit\b(?!-)
1 mit-0 spdx spdx license identifier mit-0\b
1 apache-2 spdx spdx license identifier apache-2\.0
1 apache-1.1 spdx spdx license identifier apache-1\.1
1 apache-1.0 spdx spdx license identifier apache-1\.0
1 gpl-1.0 spdx spdx license identifier gpl-1\.0
1 gpl-2.0-or-later spdx spdx license identifier gpl-2\.0(?:\+|-or-later)
1 gpl-2.0 spdx spdx license identifier gpl-2\.0(?!\+|-or-later)
1 gpl-3.0-or-later spdx spdx license identifier gpl-3\.0(?:\+|-or-later)
1 gpl-3.0 spdx spdx license identifier gpl-3\.0(?!\+|-or-later)
1 lgpl-2.0 spdx spdx license identifier lgpl-2\.0
1 lgpl-2.1-or-later spdx spdx license identifier lgpl-2\.1(?:\+|-or-later)
1 lgpl-2.1 spdx spdx license identifier lgpl-2\.1(?!\+|-or-later)
1 lgpl-3.0-or-later spdx spdx license identifier lgpl-3\.0(?:\+|-or-later)
1 lgpl-3.0 spdx spdx license identifier lgpl-3\.0(?!\+|-or-later)
1 agpl-1.0 spdx spdx license identifier agpl-1\.0
1 agpl-3.0-or-later spdx spdx license identifier agpl-3\.0(?:\+|-or-later)
1 agpl-3.0 spdx spdx license identifier agpl-3\.0(?!\+|-or-later)
1 bsd-2-clause spdx spdx license identifier bsd-2-clause
1 bsd-3-clause-clear spdx spdx license identifier bsd-3-clause-clear
1 bsd-3-clause spdx spdx license identifier bsd-3-clause(?!-)
1 bsd-4-clause spdx spdx license identifier bsd-4-clause
1 0bsd spdx spdx license identifier 0bsd
1 isc spdx spdx license identifier isc\b
1 mpl-1.0 spdx spdx license identifier mpl-1\.0
1 mpl-1.1 spdx spdx license identifier mpl-1\.1
1 mpl-2.0 spdx spdx license identifier mpl-2\.0
1 epl-1.0 spdx spdx license identifier epl-1\.0
1 epl-2.0 spdx spdx license identifier epl-2\.0
1 cddl-1.0 spdx spdx license identifier cddl-1\.0
1 cddl-1.1 spdx spdx license identifier cddl-1\.1
1 cpl-1.0 spdx spdx license identifier cpl-1\.0
1 eupl-1.1 spdx spdx license identifier eupl-1\.1
1 eupl-1.2 spdx spdx license identifier eupl-1\.2
1 artistic-1.0 spdx spdx license identifier artistic-1\.0
1 artistic-2.0 spdx spdx license identifier artistic-2\.0
1 bsl-1.0 spdx spdx license identifier bsl-1\.0
1 busl-1.1 spdx spdx license identifier busl-1\.1
1 zlib spdx spdx license identifier zlib\b
1 libpng spdx spdx license identifier libpng
1 unlicense spdx spdx license identifier unlicense
1 wtfpl spdx spdx license identifier wtfpl
1 cc0-1.0 spdx spdx license identifier cc0-1\.0
1 cc-by-4.0 spdx spdx license identifier cc-by-4\.0
1 cc-by-3.0 spdx spdx license identifier cc-by-3\.0
1 cc-by-sa-4.0 spdx spdx license identifier cc-by-sa-4\.0
1 cc-by-sa-3.0 spdx spdx license identifier cc-by-sa-3\.0
1 cc-by-nc-4.0 spdx spdx license identifier cc-by-nc-4\.0
1 cc-by-nc-sa-4.0 spdx spdx license identifier cc-by-nc-sa-4\.0
1 cc-by-nc-nd-4.0 spdx spdx license identifier cc-by-nc-nd-4\.0
1 cc-by-nd-4.0 spdx spdx license identifier cc-by-nd-4\.0
1 ofl-1.1 spdx spdx license identifier ofl-1\.1
1 ncsa spdx spdx license identifier ncsa
1 postgresql spdx spdx license identifier postgresql
1 python-2.0 spdx spdx license identifier (?:python|psf)-2\.0
1 ruby spdx spdx license identifier ruby
1 php-3.01 spdx spdx license identifier php-3\.01
1 openssl spdx spdx license identifier openssl
1 vim spdx spdx license identifier vim
1 ms-pl spdx spdx license identifier ms-pl
1 ms-rl spdx spdx license identifier ms-rl
1 afl-3.0 spdx spdx license identifier afl-3\.0
1 osl-3.0 spdx spdx license identifier osl-3\.0
1 sspl-1.0 spdx spdx license identifier sspl-1\.0
1 odbl-1.0 spdx spdx license identifier odbl-1\.0
1 pddl-1.0 spdx spdx license identifier pddl-1\.0
1 mulanpsl-2.0 spdx spdx license identifier mulanpsl-2\.0
1 mit permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 mit substantial the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 isc permission permission to use copy modify and(?: or|/or) distribute this software for any purpose with or without fee is hereby granted
1 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display
1 bsd-3-clause endorse neither the names? of .{1,120} (?:nor the names of its contributors )?may be used to endorse or promote products
1 bsd-2-clause redistributions redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
1 bsd-2-clause redistributions redistributions of source code must retain the above copyright notice
1 zlib misrepresented the origin of this software must not be misrepresented
1 zlib altered altered source versions must be plainly marked as such
1 unlicense unencumbered this is free and unencumbered software released into the public domain
1 wtfpl fuck do what the fuck you want to public license
1 gpl-2.0-or-later redistribute redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
1 gpl-3.0-or-later redistribute redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
1 lgpl-2.1-or-later redistribute redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2\.1
1 lgpl-3.0-or-later redistribute redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
1 agpl-3.0-or-later redistribute redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
1 gpl-2.0 preamble gnu general public license version 2 june 1991
1 gpl-3.0 june gnu general public license version 3 29 june 2007
1 lgpl-2.1 february gnu lesser general public license version 2\.1 february 1999
1 lgpl-3.0 june gnu lesser general public license version 3 29 june 2007
1 agpl-3.0 november gnu affero general public license version 3 19 november 2007
1 apache-2 january apache license version 2\.0 january 2004
1 apache-2 apache http www apache org licenses license-2\.0
1 mpl-2.0 mozilla https? (?:www )?mozilla org mpl 2\.0
1 mpl-2.0 mozilla this source code form is subject to the terms of the mozilla public license v 2\.0
1 mpl-1.1 mozilla the contents of this file are subject to the mozilla public license version 1\.1
1 epl-1.0 eclipse made available under the terms of the eclipse public license v1\.0
1 epl-2.0 eclipse made available under the terms of the eclipse public license v? ?2\.0
1 cddl-1.0 cddl the contents of this file are subject to the terms of the common development and distribution license
1 bsl-1.0 boost boost software license version 1\.0 august 17th 2003
1 artistic-2.0 artistic the artistic license 2\.0 copyright
1 ofl-1.1 font this font software is licensed under the sil open font license version 1\.1
1 cc0-1.0 waived to the extent possible under law .{1,120} waived all copyright
1 cc-by-4.0 creativecommons creativecommons org licenses by 4\.0
1 cc-by-3.0 creativecommons creativecommons org licenses by 3\.0
1 cc-by-2.0 creativecommons creativecommons org licenses by 2\.0
1 cc-by-sa-4.0 creativecommons creativecommons org licenses by-sa 4\.0
1 cc-by-sa-3.0 creativecommons creativecommons org licenses by-sa 3\.0
1 cc-by-sa-2.0 creativecommons creativecommons org licenses by-sa 2\.0
1 cc-by-nc-4.0 creativecommons creativecommons org licenses by-nc 4\.0
1 cc-by-nc-3.0 creativecommons creativecommons org licenses by-nc 3\.0
1 cc-by-nc-sa-4.0 creativecommons creativecommons org licenses by-nc-sa 4\.0
1 cc-by-nc-sa-3.0 creativecommons creativecommons org licenses by-nc-sa 3\.0
1 cc-by-nc-nd-4.0 creativecommons creativecommons org licenses by-nc-nd 4\.0
1 cc-by-nc-nd-3.0 creativecommons creativecommons org licenses by-nc-nd 3\.0
1 cc-by-nd-4.0 creativecommons creativecommons org licenses by-nd 4\.0
1 cc-by-nd-3.0 creativecommons creativecommons org licenses by-nd 3\.0
1 cc0-1.0 creativecommons creativecommons org publicdomain zero 1\.0
1 cc-pdm creativecommons creativecommons org publicdomain mark 1\.0
1 odbl-1.0 opendatacommons opendatacommons org licenses odbl
1 pddl-1.0 opendatacommons opendatacommons org licenses pddl
1 openssl openssl this product includes software developed by the openssl project
1 php-3.01 php this product includes php software
1 ncsa illinois university of illinois ncsa open source license
1 postgresql postgresql postgresql is released under the postgresql license
1 python-2.0 python python software foundation license version 2
1 sspl-1.0 server server side public license version 1
1 beerware beer the beer-ware license
1 json evil the software shall be used for good not evil
1 x11 consortium except as contained in this notice the name of the x consortium
1 hpnd permission permission to use copy modify and distribute this software and its documentation for any purpose and without fee
2 gpl-3.0-or-later gnu under (?:the )?(?:terms of )?(?:the )?gnu general public license(?: gpl)? (?:version|v) ?3(?:\.0)? or (?:any |\(at your option\) any )?later
2 gpl-3.0 gnu under (?:the )?(?:terms of )?(?:the )?gnu general public license(?: gpl)? (?:version |v)?3
2 gpl-2.0-or-later gnu under (?:the )?(?:terms of )?(?:the )?gnu general public license(?: gpl)? (?:version|v) ?2(?:\.0)? or (?:any |\(at your option\) any )?later
2 gpl-2.0 gnu under (?:the )?(?:terms of )?(?:the )?gnu general public license(?: gpl)? (?:version |v)?2
2 gpl gnu under (?:the )?(?:terms of )?(?:the )?gnu general public license
2 lgpl-3.0 gnu under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license (?:version |v)?3
2 lgpl-2.1 gnu under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license (?:version |v)?2\.1
2 lgpl-2.0 gnu under (?:the )?(?:terms of )?(?:the )?gnu library general public license (?:version |v)?2
2 lgpl gnu under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license
2 agpl-3.0 gnu under (?:the )?(?:terms of )?(?:the )?gnu affero general public license (?:version |v)?3
2 agpl gnu under (?:the )?(?:terms of )?(?:the )?gnu affero general public license
2 gfdl-1.3 gnu under (?:the )?(?:terms of )?(?:the )?gnu free documentation license version 1\.3
2 gfdl-1.2 gnu under (?:the )?(?:terms of )?(?:the )?gnu free documentation license version 1\.2
2 gfdl gnu under (?:the )?(?:terms of )?(?:the )?gnu free documentation license
2 gpl-3.0 gpl (?:under|released under) (?:the )?gpl ?v?3
2 gpl-2.0 gpl (?:under|released under) (?:the )?gpl ?v?2
2 lgpl-3.0 lgpl under (?:the )?lgpl ?v?3
2 lgpl-2.1 lgpl under (?:the )?lgpl ?v?2\.1
2 agpl-3.0 agpl under (?:the )?agpl ?v?3
2 mit mit under (?:the )?(?:terms of )?(?:the )?(?:expat|mit) licen[sc]e
2 mit expat under (?:the )?(?:terms of )?(?:the )?expat licen[sc]e
2 mit-0 attribution under (?:the )?mit no attribution licen[sc]e
2 apache-2 apache under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e (?:version |v)?2
2 apache-1.1 apache under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e (?:version |v)?1\.1
2 apache apache under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e
2 bsd-2-clause bsd under (?:the |a )?(?:2-clause|two-clause|simplified|freebsd) (?:bsd )?licen[sc]e
2 bsd-3-clause bsd under (?:the |a )?(?:3-clause|three-clause|new|revised|modified) bsd licen[sc]e
2 bsd-4-clause bsd under (?:the |a )?(?:4-clause|four-clause|original) bsd licen[sc]e
2 bsd bsd under (?:the |a )?(?:terms of the )?bsd(?:-style)? licen[sc]e
2 isc isc under (?:the )?isc licen[sc]e
2 mpl-2.0 mozilla under (?:the )?(?:terms of the )?mozilla public licen[sc]e (?:version |v)?2
2 mpl-1.1 mozilla under (?:the )?(?:terms of the )?mozilla public licen[sc]e (?:version |v)?1\.1
2 mpl mozilla under (?:the )?(?:terms of the )?mozilla public licen[sc]e
2 epl eclipse under (?:the )?(?:terms of the )?eclipse public licen[sc]e
2 eupl european under (?:the )?(?:terms of the )?european union public licen[sc]e
2 cddl distribution under (?:the )?(?:terms of the )?common development and distribution licen[sc]e
2 cpl-1.0 common under (?:the )?(?:terms of the )?common public licen[sc]e
2 artistic artistic under (?:the )?(?:terms of the )?(?:perl )?artistic licen[sc]e
2 bsl-1.0 boost under (?:the )?boost software licen[sc]e
2 busl-1.1 business under (?:the )?business source licen[sc]e
2 zlib zlib under (?:the )?zlib licen[sc]e
2 unlicense unlicense under (?:the )?unlicense
2 ofl-1.1 sil under (?:the )?sil open font licen[sc]e
2 cc-by-nc-nd creative under (?:a |the )?creative commons attribution non-?commercial no-?deriv(?:ative)?s? ?(?:works )?
2 cc-by-nc-sa creative under (?:a |the )?creative commons attribution non-?commercial share-?alike
2 cc-by-nc creative under (?:a |the )?creative commons attribution non-?commercial
2 cc-by-nd creative under (?:a |the )?creative commons attribution no-?derivatives
2 cc-by-sa creative under (?:a |the )?creative commons attribution share-?alike
2 cc-by creative under (?:a |the )?creative commons attribution
2 cc0-1.0 cc0 (?:under|dedicated to the public domain under) (?:the )?(?:creative commons )?cc0
2 cc-by-nc-sa cc under (?:a |the )?cc by nc sa
2 cc-by-nc-nd cc under (?:a |the )?cc by nc nd
2 cc-by-nc cc under (?:a |the )?cc by nc
2 cc-by-sa cc under (?:a |the )?cc by sa
2 cc-by-nd cc under (?:a |the )?cc by nd
2 cc-by cc under (?:a |the )?cc by
2 public-domain domain (?:released|placed|dedicated) (?:in|to|into) the public domain
2 python-2.0 python under (?:the )?python software foundation licen[sc]e
2 ruby ruby under the same terms as ruby
2 perl perl under the same terms as perl
2 ms-pl microsoft under (?:the )?microsoft public licen[sc]e
2 ms-rl microsoft under (?:the )?microsoft reciprocal licen[sc]e
2 afl academic under (?:the )?academic free licen[sc]e
2 osl open under (?:the )?open software licen[sc]e
2 odbl odbl under (?:the )?(?:odbl|open database licen[sc]e)
2 vim vim under (?:the )?vim licen[sc]e
2 openssl openssl under (?:the )?openssl licen[sc]e
2 proprietary commercial under (?:a |the )?commercial licen[sc]e
2 proprietary proprietary under (?:a |the )?proprietary licen[sc]e
3 apache-2 apache apache (?:software )?licen[sc]e (?:version |v)?2(?:\.0)?
3 apache apache apache (?:software )?licen[sc]e
3 gpl-3.0 gnu gnu (?:general public license|gpl) (?:version |v)?3
3 gpl-2.0 gnu gnu (?:general public license|gpl) (?:version |v)?2
3 gpl gnu gnu (?:general public license|gpl)
3 lgpl gnu gnu (?:lesser|library) general public license
3 agpl gnu gnu affero general public license
3 gfdl gnu gnu free documentation license
3 gpl-3.0 gpl \bgplv3\b
3 gpl-2.0 gpl \bgplv2\b
3 lgpl-3.0 lgpl \blgplv3\b
3 lgpl-2.1 lgpl \blgplv2\.1\b
3 agpl-3.0 agpl \bagplv3\b
3 mit mit \bmit licen[sc]e
3 bsd-3-clause bsd \b(?:3-clause|new|modified|revised) bsd\b
3 bsd-2-clause bsd \b(?:2-clause|simplified) bsd\b
3 bsd bsd \bbsd licen[sc]e
3 isc isc \bisc licen[sc]e
3 mpl mozilla mozilla public licen[sc]e
3 epl eclipse eclipse public licen[sc]e
3 cddl cddl \bcddl\b
3 eupl eupl \beupl\b
3 artistic artistic artistic licen[sc]e
3 bsl-1.0 boost boost software licen[sc]e
3 zlib zlib \bzlib licen[sc]e
3 ofl-1.1 sil sil open font licen[sc]e
3 cc-by-nc-sa cc \bcc by nc sa\b
3 cc-by-nc-nd cc \bcc by nc nd\b
3 cc-by-nc cc \bcc by nc\b
3 cc-by-sa cc \bcc by sa\b
3 cc-by-nd cc \bcc by nd\b
3 cc-by cc \bcc by\b (?:[1-4]\.0|licen[sc]e)
3 cc0-1.0 cc0 \bcc0\b
3 creative-commons creative creative commons
3 wtfpl wtfpl \bwtfpl\b
3 unlicense unlicense \bunlicense\b
3 public-domain domain \bpublic domain\b
4 all-rights-reserved reserved all rights reserved
4 other-permissive permission permission is (?:hereby )?granted
4 unknown-license license (?:licensed|released|distributed) under
4 unknown-license license see (?:the )?(?:accompanying )?(?:file )?licen[sc]e
4 unknown-license licence (?:licenced|released|distributed) under
4 copyright copyright copyright (?:\(c\)|©)? ?(?:19|20)\d\d
"""

#: Keywords too common in other words to tell texts apart, with a pattern that every text of theirs holds.
COMMON = {"cc": "cc[^0-9a-z]+by"}

SCORES = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.4}
_GAP = r"[\s*#/.,;:\"'()<>_=!-]{1,24}"


@lru_cache(maxsize=1)
def rules() -> list[tuple[int, str, str, str]]:
    """(class, label, keyword, Java pattern) in order of priority."""
    out = []
    for line in RULES.strip().splitlines():
        grade, label, keyword, pattern = line.split(" ", 3)
        if grade == "2" and pattern.startswith("under "):
            pattern = "(?:(?:licen[sc]ed|released|distributed) )?" + pattern  # so that a grant contains the hint of class 4
        # Spaces are gaps, " ?" an optional one. An optional part that ends in a space keeps its own gap.
        out.append((int(grade), label, keyword, "(?is)" + re.sub(r" +(\??)", lambda m: f"(?:{_GAP})?" if m[1] else _GAP, pattern)))
    return out


@lru_cache(maxsize=1)
def needed() -> tuple[list[str], list[str]]:
    """Strings and patterns in lower case, one of which stands in each text that a rule can match."""
    words: set[str] = set()
    for _, _, keyword, pattern in (line.split(" ", 3) for line in RULES.strip().splitlines()):
        while pattern != (pattern := re.sub(r"\([^()]*\)", "", pattern)):
            pass
        words.add("licen" if "licen" in keyword + " " + pattern else keyword)
    plain = {w for w in words if w not in COMMON}
    return sorted(w for w in plain if not any(v != w and v in w for v in plain)), [COMMON[w] for w in sorted(words) if w in COMMON]

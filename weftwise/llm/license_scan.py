"""License scan: ordered signature rules gated by keywords, overlaps settled by priority and containment.

Texts are read as words (ASCII upper case lowered first). Each rule is a regular expression over words
with one gate word in it; a text that has no gate word is never matched against anything. At each gate
word the rules of that gate are tried on the words around it, as many as the longest of them can take in
(counted from the rules), which gives detections as word intervals. A detection goes if another one covers
its interval and has a higher priority, or the same and is longer (or, for one interval, comes first in the
rules' order). Over 250 rules are written by hand; six more for each identifier say how texts name it.

Three base phrases are counted apart: all their places, first and last start, and their own labels.

All of it is one narrow projection of DataFrame expressions: no shuffle, no Python, one row in, one out.
Null and empty texts have no words and no labels; repeated rows and rows without an id are scanned alike; other
columns pass, and an added name that is taken gets underscores in front. Texts of any length are scanned whole.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import free_name
from weftwise.llm.quality import let

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP_PRIORITY = 9

# Phrases that are counted, their gate's place in them, and their labels.
BASE = [(("cc", "by"), 0, "cc-by"), (("general", "public", "license"), 2, "gpl"), (("all", "rights", "reserved"), 2, "reserved")]

# License identifiers by label, as words; versions are spelt as their numbers.
IDS = {
    "agpl-3.0": "agpl 3 0", "apache-1.1": "apache 1 1", "apache-2.0": "apache 2 0", "artistic-1.0": "artistic 1 0", "artistic-2.0": "artistic 2 0", "bsd-1-clause": "bsd 1 clause", "bsd-2-clause": "bsd 2 clause",
    "bsd-3-clause": "bsd 3 clause", "bsd-4-clause": "bsd 4 clause", "0bsd": "0bsd", "bsl-1.0": "bsl 1 0", "bzip2-1.0.6": "bzip2 1 0 6", "cc0-1.0": "cc0 1 0", "cc-by-2.0": "cc by 2 0", "cc-by-2.5": "cc by 2 5",
    "cc-by-3.0": "cc by 3 0", "cc-by-4.0": "cc by 4 0", "cc-by-sa-3.0": "cc by sa 3 0", "cc-by-sa-4.0": "cc by sa 4 0", "cc-by-nc-4.0": "cc by nc 4 0", "cc-by-nd-4.0": "cc by nd 4 0", "cc-by-nc-sa-4.0": "cc by nc sa 4 0",
    "cc-by-nc-nd-4.0": "cc by nc nd 4 0", "cddl-1.0": "cddl 1 0", "cddl-1.1": "cddl 1 1", "cecill-2.1": "cecill 2 1", "cecill-b": "cecill b", "cecill-c": "cecill c", "cpl-1.0": "cpl 1 0", "ecl-2.0": "ecl 2 0",
    "epl-1.0": "epl 1 0", "epl-2.0": "epl 2 0", "eupl-1.1": "eupl 1 1", "eupl-1.2": "eupl 1 2", "ftl": "ftl", "gfdl-1.2": "gfdl 1 2", "gfdl-1.3": "gfdl 1 3", "gpl-1.0": "gpl 1 0", "gpl-2.0": "gpl 2 0", "gpl-3.0": "gpl 3 0",
    "icu": "icu", "ijg": "ijg", "ipl-1.0": "ipl 1 0", "isc": "isc", "lgpl-2.0": "lgpl 2 0", "lgpl-2.1": "lgpl 2 1", "lgpl-3.0": "lgpl 3 0", "lppl-1.3c": "lppl 1 3c", "mit": "mit", "mit-0": "mit 0", "mpl-1.0": "mpl 1 0",
    "mpl-1.1": "mpl 1 1", "mpl-2.0": "mpl 2 0", "ms-pl": "ms pl", "ms-rl": "ms rl", "mulanpsl-2.0": "mulanpsl 2 0", "ncsa": "ncsa", "odbl-1.0": "odbl 1 0", "ofl-1.1": "ofl 1 1", "openssl": "openssl", "osl-3.0": "osl 3 0",
    "php-3.01": "php 3 01", "postgresql": "postgresql", "psf-2.0": "psf 2 0", "python-2.0": "python 2 0", "qpl-1.0": "qpl 1 0", "ruby": "ruby", "sissl": "sissl", "unlicense": "unlicense", "upl-1.0": "upl 1 0", "vim": "vim",
    "w3c": "w3c", "wtfpl": "wtfpl", "x11": "x11", "zlib": "zlib", "zpl-2.1": "zpl 2 1",
}

# Hand-written signatures as (label, priority, rule). The gate word stands in <>.
NOTICES = [
    ("mit", 9, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the )?<software>"),
    ("mit", 6, "the above copyright notice and this permission notice shall be included in all copies or <substantial> portions"),
    ("isc", 9, "permission to use copy modify and( or)? distribute this software for any purpose with or without <fee> is hereby granted"),
    ("bsd", 9, "<redistribution> and use in source and binary forms with or without modification are permitted"),
    ("bsd", 6, "<redistributions> (of source code|in binary form) must (retain|reproduce) the above copyright notice"),
    ("bsd-3-clause", 8, "neither the name( of)? .{0,60} may be used to <endorse> or promote products"),
    ("warranty-disclaimer", 3, "(the|this) software is provided( by .{0,60})? as is (and|without) .{0,40}<warranties>"),
    ("warranty-disclaimer", 3, "without even the implied <warranty> of merchantability"),
    ("apache-2.0", 9, "licensed under the <apache> license version 2 0"),
    ("apache-2.0", 7, "<apache> license version 2 0( january 2004)?"),
    ("apache-2.0", 7, "www <apache> org licenses license 2 0"),
    ("apache-1.1", 7, "<apache> (software )?license version 1 1"),
    ("gpl-2.0-or-later", 9, "<gnu> general public license (as published by the free software foundation )?(either )?version 2 (of the license )?or (at your option )?any later version"),
    ("gpl-3.0-or-later", 9, "<gnu> general public license (as published by the free software foundation )?(either )?version 3 (of the license )?or (at your option )?any later version"),
    ("gpl-2.0", 7, "<gnu> general public license (as published by the free software foundation )?version 2"),
    ("gpl-3.0", 7, "<gnu> general public license (as published by the free software foundation )?version 3"),
    ("gpl", 5, "<gnu> general public license"),
    ("gpl", 4, "<gnu> gpl( v ?[123])?"),
    ("gpl-2.0", 6, "<gplv2>"), ("gpl-3.0", 6, "<gplv3>"), ("lgpl-3.0", 6, "<lgplv3>"), ("agpl-3.0", 6, "<agplv3>"),
    ("lgpl-2.1-or-later", 9, "<gnu> lesser general public license (as published by the free software foundation )?(either )?version 2 1 (of the license )?or (at your option )?any later version"),
    ("lgpl", 6, "<gnu> (lesser|library) general public license"),
    ("agpl", 6, "<gnu> affero general public license"),
    ("agpl", 5, "<affero> general public license"),
    ("lgpl", 5, "(lesser|library) general public <license>"),
    ("gfdl", 6, "<gnu> free documentation license"),
    ("mpl-2.0", 9, "subject to the terms of the <mozilla> public license v(ersion)? ?2 0"),
    ("mpl", 5, "<mozilla> public license"),
    ("epl", 5, "<eclipse> public license"),
    ("cddl", 5, "common development and <distribution> license"),
    ("eupl", 5, "european union public <licence>"),
    ("bsl-1.0", 7, "<boost> software license( version 1 0)?"),
    ("artistic", 4, "<artistic> licen[cs]e"),
    ("zlib", 7, "altered source versions must be plainly marked as such and must not be <misrepresented>"),
    ("unlicense", 8, "this is free and <unencumbered> software released into the public domain"),
    ("wtfpl", 7, "do what the <fuck> you want to public license"),
    ("public-domain", 5, "(released|placed|dedicated) (in|into|to) the public <domain>"),
    ("cc0-1.0", 7, "<creative> commons (zero|cc0)"),
    ("cc-by-nc-nd", 8, "<creative> commons attribution noncommercial noderiv(s|atives)"),
    ("cc-by-nc-sa", 8, "<creative> commons attribution noncommercial sharealike"),
    ("cc-by-nc", 7, "<creative> commons attribution noncommercial"),
    ("cc-by-nd", 7, "<creative> commons attribution noderiv(s|atives)"),
    ("cc-by-sa", 7, "<creative> commons attribution share ?alike"),
    ("cc-by", 6, "<creative> commons attribution"),
    ("creative-commons", 3, "<creative> commons"),
    ("cc-by-sa", 4, "<cc> by sa"), ("cc-by-nc", 4, "<cc> by nc"), ("cc-by-nd", 4, "<cc> by nd"), ("cc-by-nc-sa", 4, "<cc> by nc sa"), ("cc-by-nc-nd", 4, "<cc> by nc nd"),
    ("ofl", 6, "sil open <font> license"),
    ("php", 5, "the <php> license"),
    ("python", 5, "<python> software foundation license"),
    ("mit", 5, "(under|with) (the|an) <mit> license"),
    ("mit", 4, "<expat> license"),
    ("proprietary", 5, "<proprietary> and confidential"),
    ("proprietary", 5, "unauthorized (copying|use|distribution) .{0,40}strictly <prohibited>"),
    ("copyright", 1, "<copyright> (c )?(19|20)[0-9]{2}( (19|20)[0-9]{2})?"),
    ("reserved", 2, "some rights <reserved>"),
    ("no-rights-reserved", 5, "no rights <reserved>"),
    # MIT and its kin
    ("mit", 7, "to deal in the software without <restriction> including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", 6, "and to permit persons to whom the software is <furnished> to do so"), ("mit", 5, "in no event shall the authors or copyright holders be liable for any claim damages or other <liability>"),
    ("mit-0", 8, "mit no <attribution>"), ("mit", 5, "released under (the )?terms of the <mit> license"), ("mit-modern-variant", 7, "permission is hereby granted without written agreement and without license or <royalty> fees"),
    ("x11", 7, "except as contained in this notice the name of .{0,40} shall not be used in <advertising>"), ("x11", 5, "<x11> license"), ("ntp", 7, "permission to use copy modify and distribute this software and its documentation for any <purpose>"),
    ("hpnd", 7, "that both that copyright notice and this permission notice appear in supporting <documentation>"), ("isc", 5, "(the )?<isc> license"), ("0bsd", 7, "zero <clause> bsd"), ("mit-advertising", 7, "the above copyright notice and this permission notice shall be included in all <advertising>"),
    ("icu", 7, "<unicode> license v3"), ("unicode", 6, "<unicode> terms of use"), ("curl", 6, "(the )?<curl> license"), ("ncsa", 7, "university of illinois ncsa open source <license>"), ("ncsa", 6, "<ncsa> open source license"),
    ("libpng", 7, "png reference <library> license"), ("libpng", 6, "(the )?<libpng> license"), ("zlib", 6, "the origin of this software must not be <misrepresented>"), ("zlib", 5, "(the )?<zlib> license"),
    ("postgresql", 6, "(the )?<postgresql> licen[cs]e"), ("afl-3.0", 7, "<academic> free license( version)? 3 0"), ("afl", 6, "<academic> free license"), ("beerware", 7, "you can buy me a <beer> in return"), ("beerware", 6, "the <beer> ware license"),
    # BSD
    ("bsd-2-clause", 7, "(simplified|freebsd) <bsd> license"), ("bsd-3-clause", 7, "(new|modified|revised) <bsd> license"), ("bsd-4-clause", 7, "(original|old) <bsd> license"), ("bsd-2-clause", 7, "(2|two) <clause> bsd"), ("bsd-3-clause", 7, "(3|three) <clause> bsd"),
    ("bsd-4-clause", 7, "(4|four) <clause> bsd"), ("bsd-4-clause", 8, "all advertising materials mentioning features or use of this software must display the following <acknowledgement>"), ("bsd", 5, "<bsd> (style )?licen[cs]ed?"), ("bsd", 4, "<bsd> style"),
    ("bsd", 4, "this software is provided by the copyright holders and <contributors> as is"), ("bsd-3-clause-clear", 8, "no express or implied licenses to any party s <patent> rights are granted"), ("bsd-2-clause-patent", 7, "<bsd> 2 clause plus patent"),
    # Apache
    ("apache-2.0", 8, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is <basis>"), ("apache-2.0", 8, "you may not use this file except in <compliance> with the license"),
    ("apache-2.0", 7, "<apache> 2 0 licen[cs]ed?"), ("apache-2.0", 6, "<apache> v ?2( 0)?"), ("apache-2.0", 6, "<asl> 2 0"), ("apache", 4, "<apache> (software )?licen[cs]e"), ("apache", 5, "this product includes software developed (by|at) the <apache> software foundation"),
    ("apache-contributor", 6, "licensed to the apache software foundation asf under one or more <contributor> license agreements"), ("apache-1.0", 7, "<apache> license( version)? 1 0"),
    # GPL and its kin
    ("gpl", 6, "you should have received a copy of the <gnu> general public license"), ("lgpl", 7, "you should have received a copy of the <gnu> lesser general public license"), ("agpl", 7, "you should have received a copy of the <gnu> affero general public license"),
    ("gpl", 5, "this program is free software you can <redistribute> it and or modify it under the terms of the gnu general public license"), ("lgpl", 6, "this library is free software you can <redistribute> it and or modify it"),
    ("gpl", 5, "in the hope that it will be <useful> but without any warranty"), ("gpl-2.0-only", 8, "<gnu> general public license version 2 only"), ("gpl-3.0-only", 8, "<gnu> general public license version 3 only"), ("gpl-2.0", 6, "<gpl> v ?2( 0)?"), ("gpl-3.0", 6, "<gpl> v ?3( 0)?"),
    ("gpl-2.0-or-later", 7, "<gpl> (v(ersion)? ?)?2( 0)? (or later|plus)"), ("gpl-3.0-or-later", 7, "<gpl> (v(ersion)? ?)?3( 0)? (or later|plus)"), ("gpl", 3, "(under|with) the <gpl>"), ("lgpl", 4, "(under|with) the <lgpl>"), ("lgpl-2.1", 6, "<lgpl> v ?2 1"), ("lgpl-3.0", 6, "<lgpl> v ?3"),
    ("agpl-3.0", 7, "<gnu> affero general public license( as published by the free software foundation)?( either)? version 3"), ("agpl-3.0", 6, "<agpl> v ?3"), ("lgpl-2.0", 7, "<gnu> library general public license( as published by the free software foundation)?( either)? version 2"),
    ("lgpl-3.0-or-later", 9, "<gnu> lesser general public license (as published by the free software foundation )?(either )?version 3 (of the license )?or (at your option )?any later version"),
    ("classpath-exception", 8, "<classpath> exception"), ("gcc-exception", 8, "gcc runtime library <exception>"), ("bison-exception", 7, "as a special exception you may create a larger work that contains part or all of the <bison> parser"), ("autoconf-exception", 7, "<autoconf> configure script exception"),
    ("linking-exception", 6, "as a special exception .{0,40} permission to <link>"), ("gfdl-1.1", 7, "<gnu> free documentation license version 1 1"), ("gfdl-1.2", 7, "<gnu> free documentation license version 1 2"), ("gfdl-1.3", 7, "<gnu> free documentation license version 1 3"),
    ("gfdl", 6, "with no invariant sections no front cover texts and no back cover <texts>"), ("copyleft", 3, "<copyleft>"), ("all-permissive", 7, "copying and distribution of this file with or without modification are permitted in any <medium>"),
    # weak copyleft
    ("mpl-1.0", 8, "<mozilla> public license( version)? 1 0"), ("mpl-1.1", 8, "<mozilla> public license( version)? 1 1"), ("mpl-2.0", 8, "<mozilla> public license( version)? 2 0"), ("mpl-2.0", 6, "a copy of the <mpl> was not distributed with this file"), ("mpl-2.0", 5, "<mpl> v ?2"),
    ("npl", 6, "<netscape> public license"), ("epl-1.0", 8, "<eclipse> public license( v(ersion)?)? ?1 0"), ("epl-2.0", 8, "<eclipse> public license( v(ersion)?)? ?2 0"), ("edl", 6, "<eclipse> distribution license"), ("cpl-1.0", 7, "<common> public license( version)? 1 0"), ("ipl-1.0", 7, "<ibm> public license"),
    ("cddl-1.0", 8, "common development and <distribution> license( cddl)?( version)? 1 0"), ("cddl-1.1", 8, "common development and <distribution> license( cddl)?( version)? 1 1"), ("apsl-2.0", 7, "<apple> public source license"), ("spl", 6, "<sun> public license"), ("qpl", 6, "<q> public license"),
    ("ms-pl", 7, "<microsoft> public license"), ("ms-rl", 7, "<microsoft> reciprocal license"), ("eupl-1.2", 7, "<eupl> v?(ersion )?1 2"), ("cecill", 5, "<cecill> (free software )?licen[cs]e"), ("osl-3.0", 7, "<open> software license( version| v)? ?3 0"), ("rpl-1.5", 6, "<reciprocal> public license"),
    ("sleepycat", 7, "(the )?<sleepycat> license"), ("artistic-2.0", 6, "<artistic> licen[cs]e 2 0"), ("artistic-1.0", 6, "<artistic> licen[cs]e 1 0"), ("clarified-artistic", 6, "<clarified> artistic license"), ("perl", 5, "under the same terms as <perl> itself"), ("ruby", 5, "(the )?<ruby> license"),
    ("lppl", 6, "<latex> project public license"), ("lppl-1.3c", 7, "<latex> project public license( version)? 1 3c?"), ("knuth", 6, "copying of this file is <authorized> only if"), ("vim", 5, "(the )?<vim> license"), ("w3c", 6, "<w3c> software (notice and )?(and document )?license"), ("zpl", 6, "<zope> public license"),
    ("php-3.01", 7, "<php> license version 3 01"), ("python-2.0", 6, "<psf> license agreement"), ("tcl", 6, "(the )?<tcl> (tk )?license"), ("openldap", 6, "the <openldap> public license"), ("openssl", 6, "(the )?<openssl> license"), ("ijg", 6, "<independent> jpeg group"), ("freetype", 6, "(the )?<freetype> (project )?license"),
    ("boost", 5, "(the )?<boost> license"), ("ecl-2.0", 7, "<educational> community license"), ("upl-1.0", 7, "<universal> permissive license"), ("mulanpsl-2.0", 7, "<mulan> (permissive software|psl) (license|v ?2)"), ("blueoak-1.0.0", 7, "<blue> oak model license"), ("wtfpl", 5, "<wtfpl>"),
    # public domain
    ("public-domain", 4, "(this (work|file|code|software) is )?in the public <domain>"), ("public-domain", 5, "<dedicates?> .{0,40} to the public domain"), ("cc-pdm-1.0", 7, "public domain <mark>"), ("unlicense", 6, "anyone is free to copy modify publish use compile sell or distribute this software .{0,40}<commercial>"),
    ("cc0-1.0", 6, "<cc0> 1 0( universal)?"), ("cc0-1.0", 8, "to the extent possible under law .{0,60} has <waived> all copyright"), ("pddl-1.0", 7, "public domain dedication and <license>"), ("us-government-work", 6, "work of the (united states|u s|us) <government>"),
    # Creative Commons and data
    ("cc-by-4.0", 8, "<creative> commons attribution 4 0( international)?"), ("cc-by-3.0", 8, "<creative> commons attribution 3 0( unported)?"), ("cc-by-2.0", 8, "<creative> commons attribution 2 0( generic)?"), ("cc-by-sa-4.0", 9, "<creative> commons attribution share ?alike 4 0( international)?"),
    ("cc-by-sa-3.0", 9, "<creative> commons attribution share ?alike 3 0( unported)?"), ("cc-by-nc-4.0", 9, "<creative> commons attribution non ?commercial 4 0( international)?"), ("cc-by-nd-4.0", 9, "<creative> commons attribution no ?deriv(s|atives) 4 0( international)?"),
    ("cc-by", 5, "<creativecommons> org licenses by"), ("cc-by-sa", 6, "<creativecommons> org licenses by sa"), ("cc-by-nc", 6, "<creativecommons> org licenses by nc"), ("cc-by-nd", 6, "<creativecommons> org licenses by nd"), ("cc-by-nc-sa", 7, "<creativecommons> org licenses by nc sa"),
    ("cc-by-nc-nd", 7, "<creativecommons> org licenses by nc nd"), ("cc0-1.0", 7, "<creativecommons> org publicdomain zero 1 0"), ("odbl-1.0", 7, "open (data commons open )?<database> license"), ("odc-by-1.0", 7, "open data commons <attribution> license"), ("ogl-uk-3.0", 7, "open <government> licen[cs]e( v(ersion)?)? ?3 0"),
    ("ogl-uk", 6, "open <government> licen[cs]e"), ("etalab-2.0", 7, "licence <ouverte>( open licence)?"), ("dl-de-by-2.0", 7, "<datenlizenz> deutschland"), ("cdla-permissive", 7, "community data <license> agreement permissive"), ("cdla-sharing", 7, "community data <license> agreement sharing"),
    ("ofl-1.1", 7, "sil open <font> license version 1 1"), ("ofl", 5, "reserved <font> name"), ("bitstream-vera", 7, "<bitstream> vera"), ("gust-font", 6, "<gust> font license"), ("apafml", 6, "<adobe> postscript afm"),
    # source-available and closed
    ("sspl-1.0", 8, "server side public <license>"), ("sspl-1.0", 5, "<sspl>"), ("busl-1.1", 8, "<business> source license( 1 1)?"), ("elastic-2.0", 7, "<elastic> license( 2 0)?"), ("commons-clause", 8, "<commons> clause( license condition)?"), ("polyform", 7, "<polyform> (noncommercial|small business|shield|strict|internal use) license"),
    ("rsal", 7, "<redis> source available license"), ("confluent", 7, "<confluent> community license"), ("parity", 6, "the <parity> public license"), ("prosperity", 6, "the <prosperity> public license"), ("openrail", 6, "<openrail>( m)?"), ("llama", 6, "<llama> [23]( [0-9])? community license"), ("rail", 6, "responsible ai <license>"),
    ("eula", 5, "end user <licen[cs]e> agreement"), ("eula", 4, "<eula>"), ("proprietary", 5, "trade <secrets?> of"), ("proprietary", 6, "may not be (reproduced|copied|distributed) .{0,40}without .{0,30}written <permission>"), ("proprietary", 5, "no part of this .{0,40} may be <reproduced>"), ("proprietary", 4, "for <internal> use only"),
    ("non-commercial", 4, "for (non|personal and non) <commercial> (use|purposes)( only)?"), ("non-commercial", 4, "<noncommercial> use only"), ("research-only", 5, "for <research> (use|purposes) only"), ("academic-only", 5, "for <academic> (use|purposes) only"), ("evaluation-only", 5, "for <evaluation> purposes only"),
    ("reserved", 2, "alle rechte <vorbehalten>"), ("reserved", 2, "tous droits <réservés>"), ("reserved", 2, "todos los derechos <reservados>"), ("shareware", 4, "<shareware>"), ("freeware", 4, "<freeware>"), ("royalty-free", 3, "<royalty> free"),
    ("copyright", 1, "<copyright> (holders?|owners?)"), ("warranty-disclaimer", 3, "<merchantability> (and|or) fitness for a particular purpose"), ("warranty-disclaimer", 3, "the entire risk as to the quality and <performance> of the program is with you"),
    ("dual-license", 4, "<dual> licensed"), ("contributor-agreement", 4, "<contributor> licen[cs]e agreement"), ("patent-grant", 4, "grants? you a perpetual worldwide .{0,60}<patent> licen[cs]e"), ("export-control", 3, "<export> (control|administration) (laws|regulations)"),
]


def _most_words(pattern: str) -> int:
    """The most words that a rule's expression can match: all of its alternatives, and gaps full of single letters."""
    spelt = re.sub(r"\.\{0,(\d+)\}", lambda m: " w" * (int(m[1]) // 2 + 1) + " ", pattern)
    return len(re.sub(r"\[[^\]]*\]|\{[^}]*\}|[()|?]", " ", spelt).split())


def rules() -> list[tuple[int, str, int, str, str, str]]:
    """(order, label, priority, gate, expression before the gate, expression from the gate on) of each rule.

    The hand-written notices, and for every identifier the ways in which texts name it.
    """
    made = list(NOTICES)
    for label, name in IDS.items():
        first, *more = name.split()
        rest = "".join(f" {w}" for w in more)
        made += [
            (label, 8, f"<spdx> license identifier {name}( only| or later)?"),
            (label, 6, f"<licensed> under( the)?( terms of)?( the)? {name}"),
            (label, 6, f"(released|distributed|available|published) under( the)? {name} <license>"),
            (label, 5, f"(the )?{name} <license>"),
            (label, 5, f"<license> (type )?{name}"),
        ]
        if more or first in ("unlicense", "wtfpl"):
            made.append((label, 4, f"<{first}>{rest}"))
    out = []
    for k, (label, priority, rule) in enumerate(made):
        before, gate, after = re.split("[<>]", rule)
        for word in _spellings(gate):
            out.append((k, label, priority, word, before, word + after))
    return out


def _spellings(gate: str) -> list[str]:
    """The words of a gate: plain, or with one letter that may be missing or one class of letters."""
    if m := re.fullmatch(r"(.*)(.)\?(.*)", gate):
        return [m[1] + m[2] + m[3], m[1] + m[3]]
    if m := re.fullmatch(r"(.*)\[(.*)\](.*)", gate):
        return [m[1] + x + m[3] for x in m[2]]
    return [gate]


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _gate_table(known: list[tuple[int, str, int, str, str, str]]) -> Column:
    """Each gate's rules, with the words before and after it that they can take in."""
    by_gate: dict[str, list] = {}
    for rule in known:
        by_gate.setdefault(rule[3], []).append(rule)

    table = {
        gate: {
            "back": max(_most_words(r[4]) for r in own), "ahead": max(_most_words(r[5]) for r in own),
            "rules": [{"k": k, "label": label, "priority": priority, "before": f"(?<= ){before}$", "after": f"^{after}(?= ) "} for k, label, priority, _, before, after in own],
        }
        for gate, own in by_gate.items()
    }
    # one literal: thousands of single ones would take longer to plan than a small table takes to scan
    return F.from_json(F.lit(json.dumps(table)), "map<string, struct<back: int, ahead: int, rules: array<struct<k: int, label: string, priority: int, before: string, after: string>>>>")


def _detections(words: Column, gates: list[str], table: Column) -> Column:
    """Every rule's matches at the gate words: (start, -stop, -priority, order, label), sorted."""
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(F.lit(gates), F.get(words, i)))

    def here(i: Column) -> Column:
        def around(g: Column) -> Column:
            low = F.greatest(i - g["back"], F.lit(0))
            back = F.array_join(F.slice(words, low + 1, i - low), " ")
            back = F.when(i > 0, F.concat(F.lit(" "), back, F.lit(" "))).otherwise(F.lit(" "))
            ahead = F.concat(F.array_join(F.slice(words, i + 1, g["ahead"]), " "), F.lit(" "))
            return let(F.struct(back.alias("back"), ahead.alias("ahead"), g["rules"].alias("rules")), tried)

        def tried(x: Column) -> Column:
            fit = F.filter(x["rules"], lambda r: F.regexp_like(x["ahead"], r["after"]) & F.regexp_like(x["back"], r["before"]))
            return F.transform(
                fit,
                lambda r: F.struct(
                    (i - _spaces(F.coalesce(F.regexp_substr(x["back"], r["before"]), F.lit("")))).cast("int").alias("start"),
                    (-(i + _spaces(F.regexp_substr(x["ahead"], r["after"])))).cast("int").alias("minus_stop"),
                    (-r["priority"]).alias("minus_priority"), r["k"].alias("k"), r["label"].alias("label"),
                ),
            )

        return let(F.element_at(table, F.get(words, i)), around)

    return F.sort_array(F.flatten(F.transform(at, here)))


def _settled(found: Column) -> Column:
    """Detections that no other one covers with a higher claim: (start, stop, priority, label).

    One pass in order of start, longest and strongest first: whatever can cover a detection came before it. For
    each priority the furthest stop so far of that priority or more is kept; who does not reach beyond it is covered.
    """
    best = F.array_repeat(F.lit(-1), TOP_PRIORITY + 1)
    stays = F.filter(found, lambda d: F.lit(False))

    def step(a: Column, d: Column) -> Column:
        stop, priority = -d["minus_stop"], -d["minus_priority"]
        reach = F.transform(a["reach"], lambda x, p: F.when(p <= priority, F.greatest(x, stop)).otherwise(x))
        return F.struct(reach.alias("reach"), F.when(F.get(a["reach"], priority) >= stop, a["stays"]).otherwise(F.array_append(a["stays"], d)).alias("stays"))

    swept = F.aggregate(found, F.struct(best.alias("reach"), stays.alias("stays")), step, lambda a: a["stays"])
    return F.transform(swept, lambda d: F.struct(d["start"], (-d["minus_stop"]).alias("stop"), (-d["minus_priority"]).alias("priority"), d["label"]))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and the settled ``detections``."""
    known = rules()
    name = {k: free_name(docs, k) for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections", "w", "base", "scan")}
    col = {k: F.col(v) for k, v in name.items()}
    gates = sorted({r[3] for r in known})
    wanted = sorted({*gates, *(p[g] for p, g, _ in BASE)})
    table = _gate_table(known)
    lowered = F.translate(F.col(text_col), _UPPER, _LOWER)
    # full lower-casing finds at least the gate words that exact ASCII lower-casing does
    all_words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(_WORD), 0)
    out = docs.withColumn(name["w"], all_words)
    out = out.withColumn(name["n_words"], F.size(col["w"]).cast("long"))
    some = F.arrays_overlap(col["w"], F.lit(wanted))
    out = out.withColumn(name["w"], F.when(some, F.regexp_extract_all(lowered, F.lit(_WORD), 0)))
    w = col["w"]

    def places(phrase: tuple[str, ...]) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _all([F.get(w, i + j).eqNullSafe(F.lit(x)) for j, x in enumerate(phrase)]))

    def named(phrase: tuple[str, ...], label: str) -> Column:
        return F.transform(places(phrase), lambda i: F.struct(i.cast("long").alias("i"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*[named(phrase, label) for phrase, _, label in BASE]))
    out = out.withColumns({name["base"]: F.when(w.isNotNull(), base), name["scan"]: F.when(w.isNotNull(), _detections(w, gates, table))})
    out = out.withColumn(name["detections"], _settled(F.coalesce(col["scan"], F.array().cast(out.schema[name["scan"]].dataType))))
    starts, hits = F.transform(col["base"], lambda x: x["i"]), F.array_sort(F.array_distinct(F.transform(col["base"], lambda x: x["label"])))
    own = F.transform(col["detections"], lambda x: x["label"])
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce(hits, F.array().cast("array<string>")), own)))
    strongest = F.coalesce(F.array_max(F.transform(col["detections"], lambda x: x["priority"])), F.lit(0)) / TOP_PRIORITY
    out = out.withColumns({
        name["n_base"]: F.coalesce(F.size(col["base"]), F.lit(0)).cast("long"), name["first_word"]: F.array_min(starts), name["last_word"]: F.array_max(starts),
        name["base_labels"]: F.coalesce(F.array_join(hits, ","), F.lit("")), name["labels"]: F.array_join(every, ","),
        name["score"]: F.greatest(strongest, F.when(F.size(col["base"]) > 0, 0.5).otherwise(0.0)).cast("double"),
    })
    return out.drop(name["w"], name["base"], name["scan"])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out

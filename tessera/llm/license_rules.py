"""Signature rules of the license scan.

A rule is (label, keywords, pattern).  Patterns are matched on a text's *normal form*: its
words in lower case, joined by one space (``CC BY-NC 4.0`` is ``cc by nc 4 0``); they begin and
end at words.  Keywords are words that every match holds, all of them: a rule is tried only
on texts with all its keywords.  Rules stand in groups of falling priority, in their order
within a group; ``WEIGHTS`` gives each group's share of certainty."""

V = r"(?: version | ver | v ?| )"  # what may stand before the number of a version
OR_LATER = r"(?: or(?: at your option)? (?:any )?later(?: version)?| or newer| plus)"

#: identifiers after the SPDX tag
SPDX = [
    ("apache-2.0", "spdx apache", r"spdx license identifier apache 2 0"),
    ("apache-1.1", "spdx apache", r"spdx license identifier apache 1 1"),
    ("mit", "spdx mit", r"spdx license identifier mit"),
    ("mit-0", "spdx mit", r"spdx license identifier mit 0"),
    ("isc", "spdx isc", r"spdx license identifier isc"),
    ("bsd-2-clause", "spdx bsd", r"spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx bsd", r"spdx license identifier bsd 3 clause"),
    ("bsd-4-clause", "spdx bsd", r"spdx license identifier bsd 4 clause"),
    ("0bsd", "spdx 0bsd", r"spdx license identifier 0bsd"),
    ("gpl-2.0-or-later", "spdx gpl", r"spdx license identifier gpl 2 0(?: or later| plus)"),
    ("gpl-2.0-only", "spdx gpl", r"spdx license identifier gpl 2 0(?: only)?"),
    ("gpl-3.0-or-later", "spdx gpl", r"spdx license identifier gpl 3 0(?: or later| plus)"),
    ("gpl-3.0-only", "spdx gpl", r"spdx license identifier gpl 3 0(?: only)?"),
    ("lgpl-2.1-or-later", "spdx lgpl", r"spdx license identifier lgpl 2 1(?: or later| plus)"),
    ("lgpl-2.1-only", "spdx lgpl", r"spdx license identifier lgpl 2 1(?: only)?"),
    ("lgpl-3.0-or-later", "spdx lgpl", r"spdx license identifier lgpl 3 0(?: or later| plus)"),
    ("lgpl-3.0-only", "spdx lgpl", r"spdx license identifier lgpl 3 0(?: only)?"),
    ("agpl-3.0-or-later", "spdx agpl", r"spdx license identifier agpl 3 0(?: or later| plus)"),
    ("agpl-3.0-only", "spdx agpl", r"spdx license identifier agpl 3 0(?: only)?"),
    ("mpl-1.1", "spdx mpl", r"spdx license identifier mpl 1 1"),
    ("mpl-2.0", "spdx mpl", r"spdx license identifier mpl 2 0"),
    ("epl-1.0", "spdx epl", r"spdx license identifier epl 1 0"),
    ("epl-2.0", "spdx epl", r"spdx license identifier epl 2 0"),
    ("eupl-1.2", "spdx eupl", r"spdx license identifier eupl 1 2"),
    ("cddl-1.0", "spdx cddl", r"spdx license identifier cddl 1 0"),
    ("cddl-1.1", "spdx cddl", r"spdx license identifier cddl 1 1"),
    ("bsl-1.0", "spdx bsl", r"spdx license identifier bsl 1 0"),
    ("busl-1.1", "spdx busl", r"spdx license identifier busl 1 1"),
    ("sspl-1.0", "spdx sspl", r"spdx license identifier sspl 1 0"),
    ("cc0-1.0", "spdx cc0", r"spdx license identifier cc0 1 0"),
    ("cc-by-3.0", "spdx cc", r"spdx license identifier cc by 3 0"),
    ("cc-by-4.0", "spdx cc", r"spdx license identifier cc by 4 0"),
    ("cc-by-sa-3.0", "spdx cc sa", r"spdx license identifier cc by sa 3 0"),
    ("cc-by-sa-4.0", "spdx cc sa", r"spdx license identifier cc by sa 4 0"),
    ("cc-by-nc-4.0", "spdx cc nc", r"spdx license identifier cc by nc 4 0"),
    ("cc-by-nd-4.0", "spdx cc nd", r"spdx license identifier cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "spdx cc nc sa", r"spdx license identifier cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "spdx cc nc nd", r"spdx license identifier cc by nc nd 4 0"),
    ("unlicense", "spdx unlicense", r"spdx license identifier unlicense"),
    ("wtfpl", "spdx wtfpl", r"spdx license identifier wtfpl"),
    ("zlib", "spdx zlib", r"spdx license identifier zlib"),
    ("artistic-2.0", "spdx artistic", r"spdx license identifier artistic 2 0"),
    ("ofl-1.1", "spdx ofl", r"spdx license identifier ofl 1 1"),
    ("odbl-1.0", "spdx odbl", r"spdx license identifier odbl 1 0"),
    ("postgresql", "spdx postgresql", r"spdx license identifier postgresql"),
    ("psf-2.0", "spdx psf", r"spdx license identifier psf 2 0"),
    ("upl-1.0", "spdx upl", r"spdx license identifier upl 1 0"),
    ("ms-pl", "spdx ms", r"spdx license identifier ms pl"),
    ("spdx-other", "spdx", r"spdx license identifier [^ ]+"),
]

#: full titles with their version
TITLES = [
    ("apache-2.0", "apache license", r"apache(?: software)? license(?: v| version)? ?2(?: 0)?"),
    ("apache-1.1", "apache license", r"apache(?: software)? license(?: v| version)? ?1 1"),
    ("apache-1.0", "apache license", r"apache(?: software)? license(?: v| version)? ?1 0"),
    ("agpl-3.0-or-later", "affero license", r"(?:gnu )?affero general public license" + V + r"3(?: 0)?" + OR_LATER),
    ("agpl-3.0", "affero license", r"(?:gnu )?affero general public license" + V + r"3(?: 0)?"),
    ("agpl-1.0", "affero license", r"affero general public license" + V + r"1(?: 0)?"),
    ("lgpl-2.0", "library license", r"(?:gnu )?library general public license" + V + r"2(?: 0)?"),
    ("lgpl-2.1-or-later", "lesser license", r"(?:gnu )?lesser general public license" + V + r"2 1" + OR_LATER),
    ("lgpl-2.1", "lesser license", r"(?:gnu )?lesser general public license" + V + r"2 1"),
    ("lgpl-3.0-or-later", "lesser license", r"(?:gnu )?lesser general public license" + V + r"3(?: 0)?" + OR_LATER),
    ("lgpl-3.0", "lesser license", r"(?:gnu )?lesser general public license" + V + r"3(?: 0)?"),
    ("gpl-3.0-or-later", "general public license", r"(?:gnu )?general public license" + V + r"3(?: 0)?" + OR_LATER),
    ("gpl-3.0", "general public license", r"(?:gnu )?general public license" + V + r"3(?: 0)?"),
    ("gpl-2.0-or-later", "general public license", r"(?:gnu )?general public license" + V + r"2(?: 0)?" + OR_LATER),
    ("gpl-2.0", "general public license", r"(?:gnu )?general public license" + V + r"2(?: 0)?"),
    ("gpl-1.0", "general public license", r"(?:gnu )?general public license" + V + r"1(?: 0)?"),
    ("gfdl-1.3", "documentation license", r"(?:gnu )?free documentation license" + V + r"1 3"),
    ("gfdl-1.2", "documentation license", r"(?:gnu )?free documentation license" + V + r"1 2"),
    ("gfdl-1.1", "documentation license", r"(?:gnu )?free documentation license" + V + r"1 1"),
    ("mpl-2.0", "mozilla license", r"mozilla public license" + V + r"2(?: 0)?"),
    ("mpl-1.1", "mozilla license", r"mozilla public license" + V + r"1 1"),
    ("mpl-1.0", "mozilla license", r"mozilla public license" + V + r"1 0"),
    ("epl-2.0", "eclipse license", r"eclipse public license" + V + r"2(?: 0)?"),
    ("epl-1.0", "eclipse license", r"eclipse public license" + V + r"1(?: 0)?"),
    ("edl-1.0", "eclipse distribution license", r"eclipse distribution license" + V + r"1(?: 0)?"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e" + V + r"1 2"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e" + V + r"1 1"),
    ("cddl-1.1", "development distribution", r"common development and distribution license" + V + r"1 1"),
    ("cddl-1.0", "development distribution", r"common development and distribution license" + V + r"1 0"),
    ("cpl-1.0", "common public license", r"common public license" + V + r"1 0"),
    ("artistic-2.0", "artistic license", r"artistic license" + V + r"2(?: 0)?"),
    ("artistic-1.0", "artistic license", r"artistic license" + V + r"1(?: 0)?"),
    ("afl-3.0", "academic license", r"academic free license" + V + r"3(?: 0)?"),
    ("osl-3.0", "software license", r"open software license" + V + r"3(?: 0)?"),
    ("ofl-1.1", "font license", r"(?:sil )?open font license" + V + r"1 1"),
    ("odbl-1.0", "database license", r"open (?:data commons open )?database license(?: odbl)?" + V + r"1 0"),
    ("odc-by-1.0", "commons attribution", r"open data commons attribution license" + V + r"1 0"),
    ("pddl-1.0", "dedication", r"open data commons public domain dedication and license" + V + r"1 0"),
    ("bsl-1.0", "boost license", r"boost software license" + V + r"1 0"),
    ("busl-1.1", "business license", r"business source license" + V + r"1 1"),
    ("sspl-1.0", "server license", r"server side public license" + V + r"1"),
    ("elastic-2.0", "elastic license", r"elastic license" + V + r"2(?: 0)?"),
    ("zpl-2.1", "zope license", r"zope public license" + V + r"2 1"),
    ("zpl-2.0", "zope license", r"zope public license" + V + r"2 0"),
    ("upl-1.0", "universal license", r"universal permissive license" + V + r"1 0"),
    ("ecl-2.0", "educational license", r"educational community license" + V + r"2 0"),
    ("ms-pl", "microsoft license", r"microsoft public license"),
    ("ms-rl", "microsoft license", r"microsoft reciprocal license"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd)(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)"),
    ("0bsd", "bsd", r"(?:bsd zero clause|zero clause bsd|0 clause bsd)(?: license)?"),
    ("mit-0", "mit attribution", r"mit no attribution(?: license)?"),
    ("openrail", "responsible ai", r"(?:open )?responsible ai license"),
    ("psf-2.0", "python foundation license", r"python software foundation license" + V + r"2"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: license(?: agreement)?)?" + V + r"2 1"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software license) ?(?:v2|v 2|version 2)"),
]

#: Creative Commons: names and short forms, the longest first
COMMONS = [
    ("cc-by-nc-nd-4.0", "cc nc nd", r"cc by nc nd" + V + r"4(?: 0)?"),
    ("cc-by-nc-nd-3.0", "cc nc nd", r"cc by nc nd" + V + r"3(?: 0)?"),
    ("cc-by-nc-nd-2.5", "cc nc nd", r"cc by nc nd" + V + r"2 5"),
    ("cc-by-nc-nd", "cc nc nd", r"cc by nc nd"),
    ("cc-by-nc-sa-4.0", "cc nc sa", r"cc by nc sa" + V + r"4(?: 0)?"),
    ("cc-by-nc-sa-3.0", "cc nc sa", r"cc by nc sa" + V + r"3(?: 0)?"),
    ("cc-by-nc-sa-2.5", "cc nc sa", r"cc by nc sa" + V + r"2 5"),
    ("cc-by-nc-sa", "cc nc sa", r"cc by nc sa"),
    ("cc-by-nc-4.0", "cc nc", r"cc by nc" + V + r"4(?: 0)?"),
    ("cc-by-nc-3.0", "cc nc", r"cc by nc" + V + r"3(?: 0)?"),
    ("cc-by-nc-2.0", "cc nc", r"cc by nc" + V + r"2(?: 0)?"),
    ("cc-by-nc", "cc nc", r"cc by nc"),
    ("cc-by-nd-4.0", "cc nd", r"cc by nd" + V + r"4(?: 0)?"),
    ("cc-by-nd-3.0", "cc nd", r"cc by nd" + V + r"3(?: 0)?"),
    ("cc-by-nd", "cc nd", r"cc by nd"),
    ("cc-by-sa-4.0", "cc sa", r"cc by sa" + V + r"4(?: 0)?"),
    ("cc-by-sa-3.0", "cc sa", r"cc by sa" + V + r"3(?: 0)?"),
    ("cc-by-sa-2.0", "cc sa", r"cc by sa" + V + r"2(?: 0)?"),
    ("cc-by-sa", "cc sa", r"cc by sa"),
    ("cc-by-4.0", "cc by", r"cc by" + V + r"4(?: 0)?"),
    ("cc-by-3.0", "cc by", r"cc by" + V + r"3(?: 0)?"),
    ("cc-by-2.5", "cc by", r"cc by" + V + r"2 5"),
    ("cc-by-2.0", "cc by", r"cc by" + V + r"2(?: 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd-4.0", "attribution noderivatives", r"attribution non ?commercial noderivatives 4 0(?: international)?"),
    ("cc-by-nc-nd", "attribution", r"attribution non ?commercial no ?deriv(?:ative|s|atives)(?: works)?"),
    ("cc-by-nc-sa-4.0", "attribution", r"attribution non ?commercial share ?alike 4 0(?: international)?"),
    ("cc-by-nc-sa", "attribution", r"attribution non ?commercial share ?alike"),
    ("cc-by-nc-4.0", "attribution", r"attribution non ?commercial 4 0(?: international)?"),
    ("cc-by-nc", "attribution", r"attribution non ?commercial"),
    ("cc-by-nd-4.0", "attribution", r"attribution no ?derivatives 4 0(?: international)?"),
    ("cc-by-nd", "attribution", r"attribution no ?deriv(?:ative|s|atives)(?: works)?"),
    ("cc-by-sa-4.0", "attribution", r"attribution share ?alike 4 0(?: international)?"),
    ("cc-by-sa-3.0", "attribution", r"attribution share ?alike 3 0(?: unported)?"),
    ("cc-by-sa", "attribution", r"attribution share ?alike"),
    ("cc-by-4.0", "attribution commons", r"creative commons attribution 4 0(?: international)?"),
    ("cc-by-3.0", "attribution commons", r"creative commons attribution 3 0(?: unported)?"),
    ("cc-by", "attribution commons", r"creative commons attribution(?: licen[cs]e)?"),
    ("cc0-1.0", "commons", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc-pdm", "domain mark", r"public domain mark(?: 1 0)?"),
    ("cc-by-nc-nd", "creativecommons nc nd", r"creativecommons org licenses by nc nd(?: \d \d)?"),
    ("cc-by-nc-sa", "creativecommons nc sa", r"creativecommons org licenses by nc sa(?: \d \d)?"),
    ("cc-by-nc", "creativecommons nc", r"creativecommons org licenses by nc(?: \d \d)?"),
    ("cc-by-nd", "creativecommons nd", r"creativecommons org licenses by nd(?: \d \d)?"),
    ("cc-by-sa", "creativecommons sa", r"creativecommons org licenses by sa(?: \d \d)?"),
    ("cc-by", "creativecommons by", r"creativecommons org licenses by(?: \d \d)?"),
    ("cc0-1.0", "creativecommons zero", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons mark", r"creativecommons org publicdomain mark 1 0"),
]

#: sentences of license texts and of notices
NOTICES = [
    ("apache-2.0", "compliance license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed basis", r"distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "reproduction distribution", r"terms and conditions for use reproduction and distribution"),
    ("apache-2.0", "contributor foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("mit", "permission granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "furnished permit", r"to permit persons to whom the software is furnished to do so"),
    ("mit", "included substantial", r"shall be included in all copies or substantial portions of the software"),
    ("isc", "permission granted fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "permission granted fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd-3-clause", "endorse promote", r"neither the name of .{1,200}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "redistribution binary", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions retain", r"redistributions of source code must retain the above copyright notice"),
    ("gpl-3.0-or-later", "published foundation", r"general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("gpl-2.0-or-later", "published foundation", r"general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version"),
    ("gpl-2.0-only", "published foundation", r"general public license version 2(?: only)? as published by the free software foundation"),
    ("lgpl-2.1-or-later", "lesser foundation", r"lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version"),
    ("lgpl-3.0-or-later", "lesser foundation", r"lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("agpl-3.0-or-later", "affero foundation", r"affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("gpl", "free redistribute modify", r"this program is free software you can redistribute it and or modify it"),
    ("lgpl", "library redistribute", r"this library is free software you can redistribute it and or modify it"),
    ("gpl", "received gnu", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "received lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl", "received affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "permission documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "subject mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla contents", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "accompanying eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1.0", "distributed boost", r"distributed under the boost software license"),
    ("unlicense", "unencumbered domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone modify", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("zlib", "damages liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("beerware", "beer return", r"you can buy me a beer in return"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e|developed by the openssl project"),
    ("php-3.01", "php license", r"php license" + V + r"3 0 ?1"),
    ("ruby", "ruby", r"(?:same terms as ruby|ruby licen[cs]e)"),
    ("perl", "perl terms", r"under the same terms as perl(?: itself)?"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("json", "good evil", r"the software shall be used for good not evil"),
    ("ntp", "permission fee documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("x11", "x11 license", r"x11 license"),
    ("icu", "icu license", r"icu license"),
    ("unicode", "unicode license", r"unicode (?:license|data files and software license)"),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?license"),
    ("ogl-uk-3.0", "government licence", r"open government licence" + V + r"3(?: 0)?"),
    ("ogl-uk", "government licence", r"open government licence"),
    ("etalab-2.0", "etalab", r"etalab(?: open licen[cs]e)?(?: 2 0)?"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland namensnennung" + V + r"2 0"),
]

#: addresses of license texts
ADDRESSES = [
    ("apache-2.0", "apache org licenses", r"(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("gpl-3.0", "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses gpl 3 0"),
    ("gpl-2.0", "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0"),
    ("lgpl-3.0", "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("agpl-3.0", "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses agpl 3 0"),
    ("gfdl", "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses fdl"),
    ("gnu", "gnu org licenses", r"(?:https? )?(?:www )?gnu org licenses"),
    ("mit", "opensource org mit", r"(?:https? )?(?:www )?opensource org licenses? mit(?: license)?"),
    ("bsd-3-clause", "opensource org bsd", r"(?:https? )?(?:www )?opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "opensource org bsd", r"(?:https? )?(?:www )?opensource org licenses? bsd 2 clause"),
    ("isc", "opensource org isc", r"(?:https? )?(?:www )?opensource org licenses? isc"),
    ("osi", "opensource org", r"(?:https? )?(?:www )?opensource org licenses?"),
    ("mpl-2.0", "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl 1 1"),
    ("epl-2.0", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org (?:legal epl 2 0|org documents epl 2 0)"),
    ("epl-1.0", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl v10"),
    ("bsl-1.0", "boost org", r"(?:https? )?(?:www )?boost org license 1 0"),
    ("unlicense", "unlicense org", r"(?:https? )?(?:www )?unlicense org"),
    ("wtfpl", "wtfpl net", r"(?:https? )?(?:www )?wtfpl net"),
    ("ofl-1.1", "sil org", r"(?:https? )?scripts sil org ofl"),
    ("odbl-1.0", "opendatacommons org", r"(?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1.0", "opendatacommons org", r"(?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", "opendatacommons org", r"(?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?"),
    ("choosealicense", "choosealicense com", r"(?:https? )?(?:www )?choosealicense com licenses [^ ]+"),
]

#: names and short forms
NAMES = [
    ("agpl-3.0-or-later", "agplv3", r"(?:gnu )?agplv3" + OR_LATER),
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl" + V + r"3(?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("agpl", "affero license", r"(?:gnu )?affero general public license"),
    ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2(?: 1)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl" + V + r"3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl" + V + r"2 1"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("lgpl", "lesser license", r"(?:gnu )?lesser general public license"),
    ("lgpl", "library license", r"gnu library general public license"),
    ("gpl-3.0-or-later", "gplv3", r"(?:gnu )?gplv3" + OR_LATER),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3"),
    ("gpl-2.0-or-later", "gplv2", r"(?:gnu )?gplv2" + OR_LATER),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl" + V + r"3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl" + V + r"2(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl", "gnu license", r"gnu general public license"),
    ("gpl", "general public license", r"general public license"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl"),
    ("gfdl", "documentation license", r"(?:gnu )?free documentation license"),
    ("apache", "apache license", r"apache(?: software)? license"),
    ("apache", "apache licensed", r"apache licensed"),
    ("mit", "mit license", r"(?:expat )?mit license"),
    ("mit", "mit licence", r"mit licence"),
    ("mit", "mit licensed", r"mit licensed"),
    ("mit", "expat license", r"expat license"),
    ("isc", "isc license", r"isc license"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e[ds]?"),
    ("mpl", "mozilla license", r"mozilla public license"),
    ("mpl-2.0", "mpl", r"mpl" + V + r"2(?: 0)?"),
    ("epl", "eclipse license", r"eclipse public license"),
    ("eupl", "eupl", r"eupl(?: 1 [12])?"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("artistic", "artistic license", r"artistic license"),
    ("bsl-1.0", "boost license", r"boost software license"),
    ("busl", "business license", r"business source license"),
    ("sspl", "sspl", r"sspl"),
    ("elastic", "elastic license", r"elastic license"),
    ("ofl", "font license", r"(?:sil )?open font license"),
    ("odbl", "odbl", r"odbl"),
    ("zlib", "zlib license", r"zlib(?: libpng)? license"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("psf", "psf license", r"psf license"),
    ("cecill", "cecill", r"cecill(?: [abc])?"),
    ("cc-by", "cc by", r"cc by"),
    ("cc", "commons license", r"creative commons license"),
    ("cc", "commons licence", r"creative commons licence"),
    ("llama", "llama license", r"llama (?:\d )?community license"),
]

#: mentions that name no license
MENTIONS = [
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", r"(?:is|are) in the public domain"),
    ("public-domain", "dedication", r"public domain dedication"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "unauthorized", r"unauthorized copying of (?:this|these) files?"),
    ("proprietary", "evaluation license", r"(?:commercial|evaluation) license agreement"),
    ("eula", "end user agreement", r"end user licen[cs]e agreement"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved"),
    ("non-commercial", "commercial", r"for non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "noncommercial", r"for noncommercial (?:use|purposes)(?: only)?"),
    ("no-redistribution", "redistribution", r"redistribution is (?:not permitted|prohibited)"),
    ("dual-license", "dual licensed", r"dual licensed"),
    ("dual-license", "licenses choice", r"at your choice of licenses"),
    ("open-source", "open source", r"open source licen[cs]e"),
    ("free-software", "free software", r"free software licen[cs]e"),
    ("unspecified", "licensed under", r"licensed under(?: the)? [^ ]+"),
    ("unspecified", "released under", r"released under (?:the |an? )?[^ ]+ licen[cs]e"),
    ("unspecified", "license terms", r"subject to the (?:license terms|terms of the licen[cs]e)"),
    ("unspecified", "see license", r"see (?:the )?(?:file )?license(?: txt| md)? (?:file )?for (?:details|more information|license information)"),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?"),
]

GROUPS = [SPDX, TITLES, COMMONS, NOTICES, ADDRESSES, NAMES, MENTIONS]
WEIGHTS = [0.98, 0.95, 0.9, 0.9, 0.85, 0.6, 0.25]

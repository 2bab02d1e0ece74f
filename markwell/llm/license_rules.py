"""Signature rules of license notices, written over normalised words (lower case, one space between words).

A family gives the label, the words that name it (a regex), and gates: every match holds a word that begins with one of them.
Forms say how a notice cites a name; each has a priority (0 wins) and a confidence. Texts are whole sentences of well-known
notices with rules of their own.
"""

from __future__ import annotations

# label, regex of the name, gate
FAMILIES = (
    ("apache-2.0", r"apache (?:software )?(?:license )?(?:v|version )?2(?: 0)?", "apache"),
    ("apache-1.1", r"apache (?:software )?(?:license )?(?:v|version )?1 1", "apache"),
    ("apache-1.0", r"apache (?:software )?(?:license )?(?:v|version )?1 0", "apache"),
    ("mit", r"(?:mit|expat)(?: x11)?(?: license| licence)?", "mit|expat"),
    ("mit-0", r"mit (?:0|no attribution)(?: license| licence)?", "mit"),
    ("x11", r"x11(?: license| licence)", "x11"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: license| licence)?|bsd 2 clause(?: license)?", "bsd"),
    ("bsd-3-clause", r"(?:modified|revised|new|3 clause|three clause) bsd(?: license| licence)?|bsd 3 clause(?: license)?", "bsd"),
    ("bsd-4-clause", r"(?:original|old|4 clause|four clause) bsd(?: license| licence)?|bsd 4 clause(?: license)?", "bsd"),
    ("0bsd", r"0bsd|zero clause bsd(?: license)?", "0bsd|zero"),
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl)(?: gpl)? (?:v|version )?1(?: 0)?", "general|gpl"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: gpl)? (?:v|version )?2(?: 0)?", "general|gpl"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: gpl)? (?:v|version )?3(?: 0)?", "general|gpl"),
    ("gpl-2.0", r"gpl ?v?2(?: 0)?", "gpl"),
    ("gpl-3.0", r"gpl ?v?3(?: 0)?", "gpl"),
    ("gpl", r"(?:gnu )?general public licen[sc]e", "public"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public license|lgpl)(?: lgpl)? (?:v|version )?2(?: 0)?", "library|lgpl"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: lgpl)? ?(?:v|version )?2 1", "lesser|lgpl"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl)(?: lgpl)? ?(?:v|version )?3(?: 0)?", "lesser|lgpl"),
    ("lgpl", r"(?:gnu )?lesser general public licen[sc]e", "lesser"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl)(?: agpl)? ?(?:v|version )?3(?: 0)?", "affero|agpl"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", "affero"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e|gfdl(?: 1 [0-3])?", "documentation|gfdl"),
    ("mpl-1.0", r"(?:mozilla public license|mpl)(?: mpl)? (?:v|version )?1 0", "mozilla|mpl"),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: mpl)? (?:v|version )?1 1", "mozilla|mpl"),
    ("mpl-2.0", r"(?:mozilla public license|mpl)(?: mpl)? (?:v|version )?2(?: 0)?", "mozilla|mpl"),
    ("epl-1.0", r"(?:eclipse public license|epl)(?: epl)? (?:v|version )?1(?: 0)?", "eclipse|epl"),
    ("epl-2.0", r"(?:eclipse public license|epl)(?: epl)? (?:v|version )?2(?: 0)?", "eclipse|epl"),
    ("cddl-1.0", r"(?:common development and distribution license|cddl)(?: cddl)? (?:v|version )?1 0", "common|cddl"),
    ("cddl-1.1", r"(?:common development and distribution license|cddl)(?: cddl)? (?:v|version )?1 1", "common|cddl"),
    ("cpl-1.0", r"common public license(?: cpl)?(?: (?:v|version )?1 0)?", "common"),
    ("eupl-1.1", r"(?:european union public licen[sc]e|eupl)(?: eupl)? ?(?:v|version )?1 1", "european|eupl"),
    ("eupl-1.2", r"(?:european union public licen[sc]e|eupl)(?: eupl)? ?(?:v|version )?1 2", "european|eupl"),
    ("isc", r"isc(?: license| licence)", "isc"),
    ("zlib", r"zlib(?: libpng)?(?: license| licence)", "zlib"),
    ("boost-1.0", r"boost software license(?: (?:v|version )?1 0)?|bsl 1 0", "boost|bsl"),
    ("artistic-1.0", r"artistic license (?:v|version )?1(?: 0)?", "artistic"),
    ("artistic-2.0", r"artistic license (?:v|version )?2(?: 0)?", "artistic"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", "wtfpl|what"),
    ("python-2.0", r"python software foundation license|psf(?: license)? (?:v|version )?2", "python|psf"),
    ("php-3.01", r"php license(?: (?:v|version )?3 01)?", "php"),
    ("openssl", r"openssl license", "openssl"),
    ("ofl-1.1", r"(?:sil )?open font license(?: (?:v|version )?1 1)?|ofl 1 1", "font|ofl"),
    ("ms-pl", r"microsoft public license(?: ms pl)?", "microsoft"),
    ("ms-rl", r"microsoft reciprocal license(?: ms rl)?", "microsoft"),
    ("odbl-1.0", r"open (?:data commons open )?database license(?: odbl)?(?: (?:v|version )?1 0)?|odbl 1 0", "database|odbl"),
    ("odc-by-1.0", r"open data commons attribution license(?: (?:v|version )?1 0)?", "commons"),
    ("pddl-1.0", r"public domain dedication and license(?: (?:v|version )?1 0)?", "dedication"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", "cc0|creative"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution)(?: international)?(?: license)? 4 0(?: international)?(?: license)?", "cc by|creative"),
    ("cc-by-3.0", r"(?:cc by|creative commons attribution)(?: unported)?(?: license)? 3 0(?: unported)?(?: license)?", "cc by|creative"),
    ("cc-by-2.0", r"(?:cc by|creative commons attribution)(?: generic)?(?: license)? 2 [05](?: generic)?(?: license)?", "cc by|creative"),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?", "cc by|creative"),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?|creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by|creative"),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by|creative"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc by|creative"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by|creative"),
    ("llama-2", r"llama 2 community license(?: agreement)?", "llama"),
    ("llama-3", r"llama 3(?: [1-3])? community license(?: agreement)?", "llama"),
    ("openrail-m", r"(?:bigscience |creativeml )?open ?rail(?: m)?(?: license)?", "openrail|rail"),
)

# regex around a name, priority, confidence
FORMS = (
    (r"spdx license identifier (?:{name})", 0, 1.0),
    (r"(?:licensed|distributed|released|available|published|provided|shared) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})", 1, 0.95),
    (r"(?:redistribute it and or modify it|redistributed|used|reused|copied|modified) under (?:the )?terms of (?:the )?(?:{name})", 1, 0.95),
    (r"(?:subject to|governed by|covered by|in accordance with) (?:the )?(?:terms of )?(?:the )?(?:{name})", 2, 0.85),
    (r"licen[sc]e (?:is |type )?(?:the )?(?:{name})", 3, 0.8),
    (r"(?:{name}) (?:terms|agreement|notice|header|text)", 4, 0.7),
    (r"(?:under|see|use|using|uses) (?:the )?(?:{name})", 5, 0.65),
)
PLAIN = (r"(?:{name})", 6, 0.5)

# Families whose bare name is too common a word to count without a citing form.
NEEDS_FORM = frozenset({"mit", "openrail-m", "gpl-1.0"})

# label, regex, gate, priority, confidence
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 0, 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "notice", 0, 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "permission", 0, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 0, 0.95),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse", "endorse", 0, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising", 0, 0.95),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance", 0, 0.9),
    ("gpl", r"this program is free software you can redistribute it and or modify", "redistribute", 0, 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify", "redistribute", 0, 0.9),
    ("gpl", r"either version [123] of the license or at your option any later version", "option", 1, 0.85),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "mozilla", 0, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 0, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", "warranty", 0, 0.9),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining", "hereby", 0, 1.0),
    ("public-domain", r"(?:released into|placed in|dedicated to|is in) the public domain", "domain", 2, 0.8),
    ("cc-by", r"(?:this|the) work is licensed under a creative commons attribution", "creative", 1, 0.85),
    ("reserved", r"all rights reserved", "reserved", 3, 0.6),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary|unauthorized (?:copying|reproduction|use) is (?:strictly )?prohibited)", "proprietary|unauthorized", 2, 0.8),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", "copyright", 5, 0.5),
)

# One of these (regexes) begins a word of any text that a rule can match; other texts are not searched. "mit" is a common word
# of German, so it counts with the words that the citing forms set before or after it.
STEMS = (
    "licen", "unlicen", "spdx", "copyright", "gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "gfdl", "ofl", "odbl", "bsl",
    "cc", "creative", "public", "apache", "reserved", "permission", "redistribut", "advertising", "contributors", "wtfpl", "psf",
    "bsd", "0bsd", "expat", "x11", "openrail", "rail", "bigscience", "proprietary", "unauthorized", "software",
    "(?:under|see|use|using|uses|subject to|governed by|covered by|in accordance with)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? mit ",
    "mit (?:0|no attribution|terms|agreement|notice|header|text) ",
)


def rules() -> list[tuple[str, str, str, int, float]]:
    """All rules as ``(label, regex, gate, priority, confidence)``, in their fixed order."""
    made = list(TEXTS)
    for label, name, gate in FAMILIES:
        for form, priority, confidence in (*FORMS, *(() if label in NEEDS_FORM else (PLAIN,))):
            made.append((label, form.format(name=name), gate, priority, confidence))
    return made

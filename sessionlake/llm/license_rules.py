"""Hand-written signatures of licences, in order.

A line is: priority, label, keywords, regular expression. Expressions are read
over lower-case words; a blank stands for the place between two words, so that
``(the )?mit`` is an optional word before another. Keywords, joined by ``+``,
are words that each match contains; the first is the rarest. Priorities: 1 wording of a licence's own text, its tag or
address; 2 a notice; 3 a title with a version; 4 a title or abbreviation; 5 a
clue. Of rules of one priority the earlier goes first.
"""

from __future__ import annotations

#: Phrases whose labels always stay: priority 0.
BASE = """
0 mit       license under the mit license
0 apache-2  license apache license version 2
0 cc-by-nc  cc      cc by nc
"""

SIGNATURES = """
1 mit permission permission is hereby granted free of charge to any person obtaining a copy( of this software and associated documentation files)?
1 mit copyright+permission the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 mit spdx spdx license identifier mit
1 mit opensource opensource org licenses? mit( license)?( php)?
1 mit-0 spdx spdx license identifier mit 0
1 mit-0 attribution mit no attribution( license)?
1 x11 consortium the name of the x consortium shall not be used in advertising
1 x11 spdx spdx license identifier x11
1 apache-2 spdx spdx license identifier apache 2 0
1 apache-2 apache apache org licenses license 2 0( txt| html)?
1 apache-2 license you may not use this file except in compliance with the license
1 apache-2 basis+warranties distributed on an as is basis without warranties or conditions of any kind
1 apache-1.1 apache this product includes software developed by the apache software foundation
1 apache-1.1 spdx spdx license identifier apache 1 1
1 apache-1.0 spdx spdx license identifier apache 1 0
1 bsd-2-clause spdx spdx license identifier bsd 2 clause
1 bsd-3-clause spdx spdx license identifier bsd 3 clause
1 bsd-4-clause spdx spdx license identifier bsd 4 clause
1 bsd-0-clause spdx spdx license identifier 0bsd
1 bsd redistribution redistribution and use in source and binary forms( with or without modification( are permitted)?)?
1 bsd redistributions redistributions of source code must retain the above copyright notice
1 bsd redistributions redistributions in binary form must reproduce the above copyright notice
1 bsd-3-clause endorse neither the names? of [^ ]+ ([^ ]+ ){0,12}may be used to endorse or promote products
1 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display
1 isc permission permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted
1 isc spdx spdx license identifier isc
1 isc opensource opensource org licenses? isc( license)?
1 gpl-2 spdx spdx license identifier gpl 2 0( only)?
1 gpl-2+ spdx spdx license identifier gpl 2 0 or later
1 gpl-3 spdx spdx license identifier gpl 3 0( only)?
1 gpl-3+ spdx spdx license identifier gpl 3 0 or later
1 lgpl-2.1 spdx spdx license identifier lgpl 2 1( only)?
1 lgpl-2.1+ spdx spdx license identifier lgpl 2 1 or later
1 lgpl-3 spdx spdx license identifier lgpl 3 0( only)?
1 lgpl-3+ spdx spdx license identifier lgpl 3 0 or later
1 agpl-3 spdx spdx license identifier agpl 3 0( only)?
1 agpl-3+ spdx spdx license identifier agpl 3 0 or later
1 gpl-2 gnu gnu org licenses (old licenses )?gpl 2 0( html| txt)?
1 gpl-3 gnu gnu org licenses gpl 3 0( html| txt)?
1 gpl gnu gnu org licenses gpl( html| txt)?
1 lgpl-2.1 gnu gnu org licenses (old licenses )?lgpl 2 1( html| txt)?
1 lgpl-3 gnu gnu org licenses lgpl 3 0( html| txt)?
1 lgpl gnu gnu org licenses lgpl( html| txt)?
1 agpl-3 gnu gnu org licenses agpl( 3 0)?( html| txt)?
1 fdl gnu gnu org licenses fdl( 1 [123])?( html| txt)?
1 gpl gnu it under the terms of the gnu general public license as published by the free software foundation
1 gpl-2+ gnu gnu general public license as published by the free software foundation either version 2
1 gpl-3+ gnu gnu general public license as published by the free software foundation either version 3
1 gpl-2 gnu gnu general public license version 2 as published by the free software foundation
1 gpl-3 gnu gnu general public license version 3 as published by the free software foundation
1 lgpl-2.1+ gnu gnu lesser general public license as published by the free software foundation either version 2 1
1 lgpl-3+ gnu gnu lesser general public license as published by the free software foundation either version 3
1 lgpl-2+ gnu gnu library general public license as published by the free software foundation either version 2
1 agpl-3+ gnu gnu affero general public license as published by the free software foundation either version 3
1 gpl warranty+hope in the hope that it will be useful but without any warranty
1 fdl permission permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 mpl-2 mozilla this source code form is subject to the terms of the mozilla public license v 2 0
1 mpl-2 mozilla mozilla org (en us )?mpl 2 0
1 mpl-2 spdx spdx license identifier mpl 2 0
1 mpl-1.1 spdx spdx license identifier mpl 1 1
1 mpl-1.1 mozilla mozilla org mpl mpl 1 1( html)?
1 mpl-1.1 mozilla contents of this file are subject to the mozilla public license version 1 1
1 epl-1 spdx spdx license identifier epl 1 0
1 epl-2 spdx spdx license identifier epl 2 0
1 epl-1 eclipse eclipse org legal epl v10( html)?
1 epl-2 eclipse eclipse org legal epl (v20|2 0)( html)?
1 edl-1 eclipse eclipse org org documents edl v10( html| php)?
1 cddl-1 spdx spdx license identifier cddl 1 0
1 cddl-1.1 spdx spdx license identifier cddl 1 1
1 cddl-1 cddl opensource org licenses? cddl( 1 0)?
1 cpl-1 spdx spdx license identifier cpl 1 0
1 ipl-1 spdx spdx license identifier ipl 1 0
1 eupl-1.1 spdx spdx license identifier eupl 1 1
1 eupl-1.2 spdx spdx license identifier eupl 1 2
1 artistic-1 spdx spdx license identifier artistic 1 0
1 artistic-2 spdx spdx license identifier artistic 2 0
1 perl perl+terms under the same terms as perl( itself)?
1 python-2 spdx spdx license identifier (python|psf) 2 0
1 php-3 spdx spdx license identifier php 3 0[01]?
1 zlib spdx spdx license identifier zlib
1 zlib origin+misrepresented the origin of this software must not be misrepresented
1 zlib altered+marked altered source versions must be plainly marked as such
1 libpng spdx spdx license identifier libpng( 2 0)?
1 boost-1 spdx spdx license identifier bsl 1 0
1 boost-1 boost boost org license 1 0 txt
1 busl-1.1 spdx spdx license identifier busl 1 1
1 wtfpl spdx spdx license identifier wtfpl
1 wtfpl fuck you just do what the fuck you want to
1 unlicense spdx spdx license identifier unlicense
1 unlicense unencumbered this is free and unencumbered software released into the public domain
1 unlicense unlicense unlicense org
1 cc0-1 spdx spdx license identifier cc0 1 0
1 cc0-1 creativecommons creativecommons org publicdomain zero 1 0
1 pddl-1 opendatacommons opendatacommons org licenses pddl( 1 0)?
1 odbl-1 opendatacommons opendatacommons org licenses odbl( 1 0)?
1 odc-by-1 opendatacommons opendatacommons org licenses by( 1 0)?
1 odbl-1 spdx spdx license identifier odbl 1 0
1 cc-by creativecommons creativecommons org licenses by [1-4] [0-9]
1 cc-by-sa creativecommons creativecommons org licenses by sa [1-4] [0-9]
1 cc-by-nc creativecommons creativecommons org licenses by nc [1-4] [0-9]
1 cc-by-nd creativecommons creativecommons org licenses by nd [1-4] [0-9]
1 cc-by-nc-sa creativecommons creativecommons org licenses by nc sa [1-4] [0-9]
1 cc-by-nc-nd creativecommons creativecommons org licenses by nc nd [1-4] [0-9]
1 cc-by-4 spdx spdx license identifier cc by 4 0
1 cc-by-sa-4 spdx spdx license identifier cc by sa 4 0
1 ofl-1.1 spdx spdx license identifier ofl 1 1
1 ofl-1.1 sil scripts sil org ofl
1 ofl-1.1 font+sil this font software is licensed under the sil open font license( version 1 1)?
1 postgresql spdx spdx license identifier postgresql
1 ncsa spdx spdx license identifier ncsa
1 afl-3 spdx spdx license identifier afl 3 0
1 osl-3 spdx spdx license identifier osl 3 0
1 ms-pl spdx spdx license identifier ms pl
1 ms-rl spdx spdx license identifier ms rl
1 openssl openssl this product includes software developed by the openssl project
1 ssleay cryptographic this product includes cryptographic software written by eric young
1 json evil+software the software shall be used for good not evil
1 beerware beer+stuff if we meet some day and you think this stuff is worth it you can buy me a beer
1 sspl-1 spdx spdx license identifier sspl 1 0
1 elastic-2 spdx spdx license identifier elastic 2 0
1 vim spdx spdx license identifier vim
1 tex-lppl latex may be distributed and or modified under the conditions of the latex project public license
1 public-domain dedicated+domain (has been |is |are )?dedicated to the public domain
1 all-rights-reserved reserved+copyright copyright ([^ ]+ ){0,8}all rights reserved
2 mit license (licensed|released|distributed|published|available) under (the )?terms of the mit license
2 mit license (licensed|released|distributed|published|available) under (the |an? )?(mit|expat)( style)? license
2 mit-0 license (licensed|released|distributed|published|available) under the mit 0 license
2 apache-2 apache (licensed|released|distributed|published|available) under (the )?apache (software )?license (version |v)?2( 0)?
2 apache-2 apache (licensed|released|distributed|published|available) under (the )?apache 2( 0)?( license)?
2 apache apache (licensed|released|distributed|published|available) under (the )?apache (software )?license
2 bsd-2-clause bsd (licensed|released|distributed|published|available) under (the |a )?(2|two) clause bsd license
2 bsd-3-clause bsd (licensed|released|distributed|published|available) under (the |a )?(3|three) clause bsd license
2 bsd-2-clause bsd (licensed|released|distributed|published|available) under (the )?bsd (2|two) clause( license)?
2 bsd-3-clause bsd (licensed|released|distributed|published|available) under (the )?bsd (3|three) clause( license)?
2 bsd bsd (licensed|released|distributed|published|available) under (the |a )?(new |simplified |modified |revised )?bsd( style)? license
2 isc isc (licensed|released|distributed|published|available) under (the )?isc license
2 gpl-2 gnu (licensed|released|distributed|published|available) under (the )?(terms of the )?gnu general public license (version |v)2( 0)?
2 gpl-3 gnu (licensed|released|distributed|published|available) under (the )?(terms of the )?gnu general public license (version |v)3( 0)?
2 gpl gnu (licensed|released|distributed|published|available) under (the )?(terms of the )?gnu (general public license|gpl)
2 gpl-2 gpl (licensed|released|distributed|published|available) under (the )?(gnu )?gpl (version )?v?2( 0)?
2 gpl-3 gpl (licensed|released|distributed|published|available) under (the )?(gnu )?gpl (version )?v?3( 0)?
2 gpl-2 gplv2 (licensed|released|distributed|published|available) under (the )?(gnu )?gplv2
2 gpl-3 gplv3 (licensed|released|distributed|published|available) under (the )?(gnu )?gplv3
2 lgpl-2.1 gnu (licensed|released|distributed|published|available) under (the )?(terms of the )?gnu lesser general public license (version |v)2 1
2 lgpl-3 gnu (licensed|released|distributed|published|available) under (the )?(terms of the )?gnu lesser general public license (version |v)3( 0)?
2 lgpl gnu (licensed|released|distributed|published|available) under (the )?(terms of the )?gnu (lesser|library) general public license
2 lgpl lgpl (licensed|released|distributed|published|available) under (the )?(gnu )?lgpl
2 agpl-3 gnu (licensed|released|distributed|published|available) under (the )?(terms of the )?gnu affero general public license (version |v)3( 0)?
2 agpl gnu (licensed|released|distributed|published|available) under (the )?(terms of the )?gnu affero general public license
2 agpl agpl (licensed|released|distributed|published|available) under (the )?(gnu )?agpl
2 mpl-2 mozilla (licensed|released|distributed|published|available) under (the )?mozilla public license (version |v )?2( 0)?
2 mpl mozilla (licensed|released|distributed|published|available) under (the )?mozilla public license
2 epl-2 eclipse (licensed|released|distributed|published|available) under (the )?eclipse public license (version |v )?2( 0)?
2 epl-1 eclipse (licensed|released|distributed|published|available) under (the )?eclipse public license (version |v )?1( 0)?
2 epl eclipse (licensed|released|distributed|published|available) under (the )?eclipse public license
2 cddl common+license (licensed|released|distributed|published|available) under (the )?common development and distribution license
2 eupl eupl (licensed|released|distributed|published|available) under (the )?eupl
2 artistic artistic (licensed|released|distributed|published|available) under (the )?artistic license
2 zlib zlib (licensed|released|distributed|published|available) under (the )?zlib (libpng )?license
2 boost-1 boost+license (licensed|released|distributed|published|available) under (the )?boost software license
2 wtfpl wtfpl (licensed|released|distributed|published|available) under (the )?wtfpl
2 unlicense unlicense (licensed|released|distributed|published|available) under (the )?unlicense
2 cc0-1 cc0 (licensed|released|distributed|published|available) under (the )?(creative commons )?cc0( 1 0)?
2 cc-by-nc-sa cc (licensed|released|distributed|published|available) under (the |a )?cc by nc sa( [1-4] [0-9])?
2 cc-by-nc-nd cc (licensed|released|distributed|published|available) under (the |a )?cc by nc nd( [1-4] [0-9])?
2 cc-by-nc cc (licensed|released|distributed|published|available) under (the |a )?cc by nc( [1-4] [0-9])?
2 cc-by-nd cc (licensed|released|distributed|published|available) under (the |a )?cc by nd( [1-4] [0-9])?
2 cc-by-sa cc (licensed|released|distributed|published|available) under (the |a )?cc by sa( [1-4] [0-9])?
2 cc-by cc (licensed|released|distributed|published|available) under (the |a )?cc by( [1-4] [0-9])?
2 creative-commons creative (licensed|released|distributed|published|available) under (the |a )?creative commons
2 ofl-1.1 sil (licensed|released|distributed|published|available) under (the )?sil open font license
2 public-domain domain+public (released|placed|is|are|put) (in|into|to) the public domain
2 proprietary proprietary (this )?(software|document|information|material) is (confidential and )?proprietary
3 apache-2 apache apache (software )?license (version |v )?2 0
3 apache-2 apache apache 2 0( license)?
3 apache-1.1 apache apache (software )?license (version |v )?1 1
3 gpl-1 gnu gnu general public license (version |v )?1( 0)?
3 gpl-2+ gnu gnu general public license (version |v )?2( 0)? or (any )?later( version)?
3 gpl-3+ gnu gnu general public license (version |v )?3( 0)? or (any )?later( version)?
3 gpl-2 gnu gnu general public license (version |v )?2( 0)?
3 gpl-3 gnu gnu general public license (version |v )?3( 0)?
3 gpl-2 gpl (gnu )?gpl (version |v )?v?2( 0)?
3 gpl-3 gpl (gnu )?gpl (version |v )?v?3( 0)?
3 gpl-2+ gplv2 (gnu )?gplv2 or later
3 gpl-3+ gplv3 (gnu )?gplv3 or later
3 gpl-2 gplv2 (gnu )?gplv2
3 gpl-3 gplv3 (gnu )?gplv3
3 lgpl-2.1 gnu gnu lesser general public license (version |v )?2 1
3 lgpl-3 gnu gnu lesser general public license (version |v )?3( 0)?
3 lgpl-2 gnu gnu library general public license (version |v )?2( 0)?
3 lgpl-2.1 lgpl (gnu )?lgpl (version |v )?v?2 1
3 lgpl-3 lgpl (gnu )?lgpl (version |v )?v?3( 0)?
3 lgpl-3 lgplv3 (gnu )?lgplv3
3 agpl-3 gnu gnu affero general public license (version |v )?3( 0)?
3 agpl-3 agpl (gnu )?agpl (version |v )?v?3( 0)?
3 agpl-3 agplv3 (gnu )?agplv3
3 fdl-1.3 gnu gnu free documentation license (version |v )?1 3
3 mpl-2 mozilla mozilla public license (version |v )?2( 0)?
3 mpl-1.1 mozilla mozilla public license (version |v )?1 1
3 mpl-2 mpl mpl (version |v )?2 0
3 epl-1 eclipse eclipse public license (version |v )?1( 0)?
3 epl-2 eclipse eclipse public license (version |v )?2( 0)?
3 cddl-1 common+license common development and distribution license (version |v )?1 0
3 eupl-1.2 union+european european union public licen[cs]e (version |v )?1 2
3 artistic-2 artistic artistic license (version |v )?2( 0)?
3 python-2 python+license python software foundation license (version )?2
3 php-3 php php license (version |v )?3( 0[01]?)?
3 boost-1 boost+license boost software license (version )?1( 0)?
3 cc-by-4 attribution creative commons attribution (license )?4 0( international)?( public)?( license)?
3 cc-by-3 attribution creative commons attribution (license )?3 0( unported)?( license)?
3 cc-by-sa-4 sharealike creative commons attribution sharealike (license )?4 0( international)?( public)?( license)?
3 cc-by-sa-3 sharealike creative commons attribution sharealike (license )?3 0( unported)?( license)?
3 cc-by-nc-4 noncommercial creative commons attribution noncommercial (license )?4 0( international)?( public)?( license)?
3 cc-by-nc-sa-4 sharealike creative commons attribution noncommercial sharealike (license )?4 0( international)?( public)?( license)?
3 cc-by-nc-nd-4 noderivatives creative commons attribution noncommercial noderivatives (license )?4 0( international)?( public)?( license)?
3 cc-by-nd-4 noderivatives creative commons attribution noderivatives (license )?4 0( international)?( public)?( license)?
3 ofl-1.1 sil sil open font license (version |v )?1 1
3 osl-3 open+license open software license (version |v )?3( 0)?
3 afl-3 academic+license academic free license (version |v )?3( 0)?
3 sspl-1 server+license server side public license (version )?1
3 elastic-2 elastic+license elastic license (version )?2( 0)?
3 odbl-1 database+license open (data commons )?(open )?database license (version |v )?1 0
4 mit license (the )?(mit|expat|x11) license
4 apache apache apache (software )?license
4 bsd bsd (the )?bsd license
4 bsd-2-clause bsd (bsd (2|two) clause|(2|two) clause bsd)( license)?
4 bsd-3-clause bsd (bsd (3|three) clause|(3|three) clause bsd)( license)?
4 isc isc (the )?isc license
4 gpl gnu gnu (general public license|gpl)
4 gpl gpl gpl
4 gpl general+license general public license
4 lgpl gnu gnu (lesser|library) (general public license|gpl)
4 lgpl lgpl lgpl
4 agpl gnu gnu affero (general public license|gpl)
4 agpl agpl agpl
4 fdl gnu gnu free documentation license
4 mpl mozilla mozilla public license
4 epl eclipse eclipse public license
4 cddl cddl cddl
4 cddl common+license common development and distribution license
4 cpl common+license common public license
4 eupl eupl eupl
4 eupl union+european european union public licen[cs]e
4 artistic artistic (the )?artistic license
4 python python+license python (software foundation )?license
4 php php php license
4 ruby ruby+license ruby license
4 zlib zlib zlib (libpng )?license
4 boost boost+license boost software license
4 wtfpl wtfpl wtfpl
4 wtfpl fuck do what the fuck you want to public license
4 unlicense unlicense (the )?unlicense
4 cc0 cc0 (creative commons )?cc0
4 cc-by-nc-sa cc cc by nc sa( [1-4] [0-9])?
4 cc-by-nc-nd cc cc by nc nd( [1-4] [0-9])?
4 cc-by-nd cc cc by nd( [1-4] [0-9])?
4 cc-by-sa cc cc by sa( [1-4] [0-9])?
4 cc-by cc cc by( [1-4] [0-9])?
4 creative-commons creative creative commons( attribution)?( license)?
4 ofl sil sil open font license
4 postgresql postgresql postgresql license
4 ncsa ncsa (university of illinois )?ncsa (open source )?license
4 ms-pl microsoft microsoft public license
4 ms-rl microsoft microsoft reciprocal license
4 beerware beerware beerware( license)?
4 odbl database+license open database license
4 public-domain domain+public (in |into |to )?the public domain
5 free-license free+license free software license
5 open-license open+license open source license
5 commercial-license commercial+license commercial license
5 proprietary proprietary+license proprietary license
5 see-license license see (the )?(accompanying )?license( file)?( for details)?
5 licensed-under licensed licensed under( the)?( terms of)?
5 license-agreement license end user license agreement
5 no-derivatives derivatives+no no derivatives
5 non-commercial commercial+non (for )?non commercial use( only)?
5 copyleft copyleft copyleft
"""


def parsed(text: str) -> list[tuple[int, str, str, str]]:
    """(priority, label, keywords, expression) of the lines of ``text``."""
    rows = [line.split(None, 3) for line in text.strip().splitlines()]
    return [(int(p), label, keywords, expression.strip()) for p, label, keywords, expression in rows]


def compiled(expression: str) -> str:
    """The expression over words in angle brackets."""
    return "<" + expression.replace(" ", "><") + ">"


#: In the order in which they go: (number, priority, label, keywords, pattern, confidence).
RULES = [(n, p, label, keywords.split("+"), compiled(e), (20 - 3 * p) / 20)
         for n, (p, label, keywords, e) in enumerate(sorted(parsed(BASE) + parsed(SIGNATURES), key=lambda r: r[0]))]

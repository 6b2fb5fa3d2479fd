"""Signature rules for licenses: `priority | license | keyword | expression`, one a line, in order.

A rule's expression is only tried on texts that have its keyword (lower case). Expressions ignore case and a space in them
stands for any white space. Higher priorities are more specific: 9 identifiers and tags, 8 full license texts, 7 license
grants with a version, 6 grants and names with a version, 5 names without a version, 4 URLs, 2 mere hints.
"""

RULES = r"""
9 | SPDX | spdx-license-identifier | SPDX-License-Identifier: *\(?[A-Za-z0-9.+\-]+(?: (?:AND|OR|WITH) \(?[A-Za-z0-9.+\-]+\)?)*\)?
9 | SPDX | spdx-license-expression | SPDX-License-Expression: *[A-Za-z0-9.+\-]+
9 | declared | license-file | ^License-File: *[^\n]{1,80}
9 | declared | "license" | "license" *: *"[^"\n]{1,60}"
9 | declared | 'license' | 'license' *: *'[^'\n]{1,60}'
9 | declared | license = | ^ *license *= *["'][^"'\n]{1,60}["']
9 | declared | license :: osi approved | License :: OSI Approved(?: :: [^\n"']{1,80})?
9 | declared | <license> | <license>\s*<name>[^<\n]{1,80}</name>
8 | Apache-2.0 | terms and conditions for use, reproduction | TERMS AND CONDITIONS FOR USE, REPRODUCTION,? AND DISTRIBUTION
8 | Apache-2.0 | you may not use this file except | Licensed under the Apache License, Version 2\.0 \(the "License"\);?,? you may not use this (?:file|work|software) except in compliance
8 | Apache-2.0 | to you under the apache license | licenses this file to you under the Apache License, Version 2\.0
8 | MIT | permission is hereby granted, free of charge | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
8 | MIT | the above copyright notice and this permission notice | The above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions
8 | MIT | without restriction, including without limitation | deal in the Software without restriction, including without limitation the rights to use, copy, modify
7 | MIT-0 | mit no attribution | MIT No Attribution(?: License)?
8 | ISC | permission to use, copy, modify, and/or distribute | Permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted,? provided that
8 | 0BSD | permission to use, copy, modify, and/or distribute | Permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\.
8 | HPND | permission to use, copy, modify, distribute | Permission to use, copy, modify, distribute,? and sell this software and its documentation for any purpose
8 | BSD-3-Clause | neither the name of | Neither the name of [^\n]{0,120}(?:\s+[^\n]{0,80})? may be used to endorse or promote products
8 | BSD-4-Clause | all advertising materials mentioning | All advertising materials mentioning features or use of this software must display
8 | BSD-2-Clause | redistribution and use in source and binary forms | Redistribution and use in source and binary forms, with or without modification, are permitted provided that
8 | BSD-2-Clause | redistributions in binary form must | Redistributions in binary form must reproduce the above copyright notice
8 | BSD-2-Clause | redistributions of source code must | Redistributions of source code must retain the above copyright notice
8 | BSD-1-Clause | redistribution and use of this software | Redistribution and use of this software in source and binary forms
8 | BSD-3-Clause-Clear | no express or implied licenses to any party | NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'?S PATENT RIGHTS ARE GRANTED
8 | GPL-2.0 | gnu general public license version 2, june | GNU GENERAL PUBLIC LICENSE Version 2, June 1991
8 | GPL-3.0 | gnu general public license version 3, 29 | GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
8 | GPL-1.0 | gnu general public license version 1, feb | GNU GENERAL PUBLIC LICENSE Version 1, February 1989
8 | LGPL-2.1 | lesser general public license version 2.1, feb | GNU LESSER GENERAL PUBLIC LICENSE Version 2\.1, February 1999
8 | LGPL-3.0 | lesser general public license version 3, 29 | GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007
8 | LGPL-2.0 | library general public license version 2, june | GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991
8 | AGPL-3.0 | affero general public license version 3, 19 | GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
8 | GFDL-1.3 | free documentation license version 1.3, 3 | GNU Free Documentation License Version 1\.3, 3 November 2008
8 | GFDL-1.2 | free documentation license version 1.2, nov | GNU Free Documentation License Version 1\.2, November 2002
8 | GFDL-1.1 | free documentation license version 1.1, mar | GNU Free Documentation License Version 1\.1, March 2000
7 | GPL-2.0-or-later | either version 2 of the license, or | GNU General Public License as published by the Free Software Foundation[;,]? either version 2 of the License, or \(?at your option\)? any later version
7 | GPL-3.0-or-later | either version 3 of the license, or | GNU General Public License as published by the Free Software Foundation[;,]? either version 3 of the License, or \(?at your option\)? any later version
7 | LGPL-2.1-or-later | either version 2.1 of the license, or | GNU Lesser General Public License as published by the Free Software Foundation[;,]? either version 2\.1 of the License, or \(?at your option\)? any later version
7 | LGPL-3.0-or-later | lesser general public license | GNU Lesser General Public License as published by the Free Software Foundation[;,]? either version 3 of the License, or \(?at your option\)? any later version
7 | LGPL-2.0-or-later | library general public license | GNU Library General Public License as published by the Free Software Foundation[;,]? either version 2 of the License, or \(?at your option\)? any later version
7 | AGPL-3.0-or-later | affero general public license | GNU Affero General Public License as published by the Free Software Foundation[;,]? either version 3 of the License, or \(?at your option\)? any later version
7 | GPL-2.0-only | version 2 of the license only | version 2 of the License only
7 | GPL-2.0-only | under the terms of the gnu general public license version 2 | under the terms of the GNU General Public License version 2(?: only)?(?: as published)?
7 | GPL-3.0-only | under the terms of the gnu general public license version 3 | under the terms of the GNU General Public License version 3(?: only)?(?: as published)?
7 | GPL-3.0-or-later | general public license, version 3 or | GNU General Public License, version 3 or (?:any )?later
7 | GPL-2.0-or-later | general public license, version 2 or | GNU General Public License, version 2 or (?:any )?later
6 | GPL-3.0 | general public license | (?:licensed under |released under |distributed under |under )?(?:the )?(?:terms of the )?GNU General Public License,? \(?(?:version|v\.?) ?3(?:\.0)?\)?
6 | GPL-2.0 | general public license | (?:licensed under |released under |distributed under |under )?(?:the )?(?:terms of the )?GNU General Public License,? \(?(?:version|v\.?) ?2(?:\.0)?\)?
6 | GPL-1.0 | general public license | GNU General Public License,? \(?(?:version|v\.?) ?1(?:\.0)?\b\)?
6 | LGPL-3.0 | lesser general public license | GNU Lesser General Public License,? \(?(?:version|v\.?) ?3(?:\.0)?\)?
6 | LGPL-2.1 | lesser general public license | GNU Lesser General Public License,? \(?(?:version|v\.?) ?2\.1\)?
6 | LGPL-2.0 | library general public license | GNU Library General Public License,? \(?(?:version|v\.?) ?2(?:\.0)?\)?
6 | AGPL-3.0 | affero general public license | GNU Affero General Public License,? \(?(?:version|v\.?) ?3(?:\.0)?\)?
6 | AGPL-1.0 | affero general public license | Affero General Public License,? \(?(?:version|v\.?) ?1(?:\.0)?\)?
6 | GPL-3.0 | gpl | \bGPL ?-?v?3(?:\.0)?(?:\+| or later|-only|-or-later)?(?![\w.])
6 | GPL-2.0 | gpl | \bGPL ?-?v?2(?:\.0)?(?:\+| or later|-only|-or-later)?(?![\w.])
6 | LGPL-3.0 | lgpl | \bLGPL ?-?v?3(?:\.0)?(?:\+| or later|-only|-or-later)?(?![\w.])
6 | LGPL-2.1 | lgpl | \bLGPL ?-?v?2\.1(?:\+| or later|-only|-or-later)?(?![\w.])
6 | LGPL-2.0 | lgpl | \bLGPL ?-?v?2(?:\.0)?(?:\+| or later|-only|-or-later)?(?![\w.])
6 | AGPL-3.0 | agpl | \bAGPL ?-?v?3(?:\.0)?(?:\+| or later|-only|-or-later)?(?![\w.])
5 | GPL | general public license | \bGNU General Public License\b
5 | GPL | gnu gpl | \bGNU GPL\b
5 | LGPL | lesser general public license | \bGNU Lesser General Public License\b
5 | LGPL | library general public license | \bGNU Library General Public License\b
5 | LGPL | gnu lgpl | \bGNU LGPL\b
5 | AGPL | affero general public license | \b(?:GNU )?Affero General Public License\b
5 | GPL-with-classpath-exception | classpath exception | \bClasspath[ -]exception(?: 2\.0)?
7 | GPL-with-classpath-exception | linking this library statically | Linking this library statically or dynamically with other modules
7 | GPL-with-GCC-exception | gcc runtime library exception | GCC Runtime Library Exception(?:, version 3\.1)?
7 | GPL-with-autoconf-exception | autoconf configure script | generated by Autoconf,? (?:you may|as a special exception)|Autoconf Configure Script Exception
7 | GPL-with-font-exception | font exception | \bGPL(?:-[23]\.0)? with font exception
7 | LLVM-exception | llvm exceptions | Apache License,? v(?:ersion)? ?2\.0,? with LLVM Exceptions?
7 | Linux-syscall-note | linux-syscall-note | \bLinux-syscall-note\b
6 | GFDL-1.3 | free documentation license | GNU Free Documentation License,? (?:version|v\.?) ?1\.3(?: or (?:any )?later)?
6 | GFDL-1.2 | free documentation license | GNU Free Documentation License,? (?:version|v\.?) ?1\.2(?: or (?:any )?later)?
6 | GFDL-1.1 | free documentation license | GNU Free Documentation License,? (?:version|v\.?) ?1\.1(?: or (?:any )?later)?
5 | GFDL | free documentation license | \bGNU Free Documentation License\b
7 | Apache-2.0 | licensed under the apache license | (?:dual[- ])?licensed under the Apache License,? (?:version|v\.?) ?2(?:\.0)?
7 | Apache-2.0 | released under the apache | released under (?:the )?Apache(?: Software)? License,? (?:version|v\.?)? ?2(?:\.0)?
7 | Apache-2.0 | distributed under the apache | distributed under (?:the )?Apache(?: Software)? License,? (?:version|v\.?)? ?2(?:\.0)?
6 | Apache-2.0 | apache license | Apache License,? \(?(?:version|v\.?)? ?2(?:\.0)?\)?
6 | Apache-2.0 | apache software license | Apache Software License,? \(?(?:version|v\.?)? ?2(?:\.0)?\)?
6 | Apache-1.1 | apache software license | Apache Software License,? \(?(?:version|v\.?)? ?1\.1\)?
6 | Apache-1.0 | apache | Apache (?:Software )?License,? \(?(?:version|v\.?)? ?1\.0\)?
6 | Apache-2.0 | asl 2.0 | \bASL 2\.0\b
6 | Apache-2.0 | apache-2.0 | \bApache-2\.0\b
6 | Apache-2.0 | apache 2.0 | \bApache 2\.0(?: license)?\b
5 | Apache | apache license | \bApache License\b
5 | Apache | apache software license | \bApache Software License\b
7 | MIT | released under the mit | (?:released|distributed|licensed|available|provided|made available) under (?:the )?(?:terms of the )?MIT(?:/X11|/Expat)? licen[sc]e
7 | MIT | licensed under the mit | (?:dual[- ])?licensed under (?:the )?(?:terms of the )?MIT licen[sc]e
7 | MIT | under the terms of the mit | under the terms of the MIT licen[sc]e
7 | MIT | licensed under mit | licensed under MIT\b
6 | MIT | the mit license | \bThe MIT License(?: \(MIT\))?
6 | MIT | mit/x11 | \bMIT/X11(?: licen[sc]e)?
6 | X11 | x11 license | \bX11 License\b
6 | MIT | expat license | \bExpat License\b
5 | MIT | mit license | \bMIT Licen[sc]e\b
5 | MIT | mit-style | \bMIT-style licen[sc]e\b
5 | MIT | mit licensed | \bMIT[ -]licensed\b
7 | BSD-3-Clause | licensed under the bsd 3 | licensed under the BSD 3[- ]Clause
6 | BSD-3-Clause | bsd 3-clause | \bBSD 3-Clause(?: "?(?:New|Revised)"?(?: or "?(?:New|Revised)"?)?)?(?: Licen[sc]e)?
6 | BSD-3-Clause | 3-clause bsd | \b3-Clause BSD(?: Licen[sc]e)?
6 | BSD-3-Clause | new bsd license | \bNew BSD Licen[sc]e\b
6 | BSD-3-Clause | modified bsd license | \bModified BSD Licen[sc]e\b
6 | BSD-3-Clause | revised bsd license | \bRevised BSD Licen[sc]e\b
6 | BSD-3-Clause | bsd-3-clause | \bBSD-3-Clause\b
6 | BSD-2-Clause | bsd 2-clause | \bBSD 2-Clause(?: "?Simplified"?)?(?: Licen[sc]e)?
6 | BSD-2-Clause | 2-clause bsd | \b2-Clause BSD(?: Licen[sc]e)?
6 | BSD-2-Clause | simplified bsd | \bSimplified BSD Licen[sc]e\b
6 | BSD-2-Clause | freebsd license | \bFreeBSD Licen[sc]e\b
6 | BSD-2-Clause | bsd-2-clause | \bBSD-2-Clause\b
6 | BSD-4-Clause | original bsd license | \bOriginal BSD Licen[sc]e\b
6 | BSD-4-Clause | bsd 4-clause | \bBSD 4-Clause\b
6 | BSD-4-Clause | 4-clause bsd | \b4-Clause BSD\b
6 | 0BSD | zero-clause bsd | \bZero-Clause BSD\b
6 | 0BSD | 0bsd | \b0BSD\b
7 | BSD | bsd-style license that can be found | governed by a BSD-style license that can be found in the LICENSE file
5 | BSD | bsd-style | \bBSD-style licen[sc]e\b
5 | BSD | bsd license | \bBSD Licen[sc]e\b
5 | BSD | bsd licensed | \bBSD[ -]licensed\b
6 | ISC | isc license | \b(?:the )?ISC Licen[sc]e\b
5 | ISC | under the isc | under the ISC\b
7 | MPL-2.0 | subject to the terms of the mozilla public | subject to the terms of the Mozilla Public License,? v(?:\.|ersion)? ?2\.0
7 | MPL-1.1 | subject to the mozilla public license version 1.1 | subject to the Mozilla Public License Version 1\.1
6 | MPL-2.0 | mozilla public license | Mozilla Public License,? \(?(?:version|v\.?)? ?2\.0\)?
6 | MPL-1.1 | mozilla public license | Mozilla Public License,? \(?(?:version|v\.?)? ?1\.1\)?
6 | MPL-1.0 | mozilla public license | Mozilla Public License,? \(?(?:version|v\.?)? ?1\.0\)?
6 | MPL-2.0 | mpl | \bMPL ?-?v?2(?:\.0)?(?![\w.])
6 | MPL-1.1 | mpl | \bMPL ?-?v?1\.1(?![\w.])
5 | MPL | mozilla public license | \bMozilla Public License\b
6 | EPL-2.0 | eclipse public license | Eclipse Public License,? (?:-|–)? ?\(?(?:version|v\.?)? ?2\.0\)?
6 | EPL-1.0 | eclipse public license | Eclipse Public License,? (?:-|–)? ?\(?(?:version|v\.?)? ?1\.0\)?
6 | EPL-2.0 | epl-2.0 | \bEPL-2\.0\b
6 | EPL-1.0 | epl-1.0 | \bEPL-1\.0\b
5 | EPL | eclipse public license | \bEclipse Public License\b
6 | EDL-1.0 | eclipse distribution license | Eclipse Distribution License(?:,? (?:-|–)? ?(?:version|v\.?) ?1\.0)?
6 | CDDL-1.1 | common development and distribution license | Common Development and Distribution License,? \(?(?:CDDL\) )?(?:version|v\.?)? ?1\.1\)?
6 | CDDL-1.0 | common development and distribution license | Common Development and Distribution License,? \(?(?:CDDL\) )?(?:version|v\.?)? ?1\.0\)?
5 | CDDL | common development and distribution license | \bCommon Development and Distribution License\b
5 | CDDL | cddl | \bCDDL\b
6 | CPL-1.0 | common public license | Common Public License(?:,? (?:version|v\.?)? ?1\.0)?
6 | CPAL-1.0 | common public attribution license | Common Public Attribution License(?:,? (?:version|v\.?)? ?1\.0)?
6 | EUPL-1.2 | european union public licen | European Union Public Licen[sc]e,? \(?(?:EUPL\)? )?(?:version|v\.?)? ?1\.2
6 | EUPL-1.1 | european union public licen | European Union Public Licen[sc]e,? \(?(?:EUPL\)? )?(?:version|v\.?)? ?1\.1
5 | EUPL | european union public licen | \bEuropean Union Public Licen[sc]e\b
5 | EUPL | eupl | \bEUPL(?:[ -]v?1\.[012])?\b
6 | CC0-1.0 | cc0 | \bCC0(?:[- ]1\.0)?(?: Universal)?\b
6 | CC0-1.0 | creative commons zero | \bCreative Commons Zero(?: v?1\.0)?\b
7 | CC0-1.0 | dedicated the work to the public domain | has dedicated the work to the public domain
7 | CC-BY-NC-SA-4.0 | attribution-noncommercial-sharealike | (?:Creative Commons )?Attribution-Non-?Commercial-ShareAlike 4\.0(?: International)?
7 | CC-BY-NC-SA-3.0 | attribution-noncommercial-sharealike | (?:Creative Commons )?Attribution-Non-?Commercial-ShareAlike 3\.0(?: Unported)?
7 | CC-BY-NC-ND-4.0 | attribution-noncommercial-noderiv | (?:Creative Commons )?Attribution-Non-?Commercial-NoDerivs?(?:atives)? 4\.0(?: International)?
7 | CC-BY-NC-ND-3.0 | attribution-noncommercial-noderiv | (?:Creative Commons )?Attribution-Non-?Commercial-NoDerivs?(?:atives)? 3\.0(?: Unported)?
7 | CC-BY-NC-4.0 | attribution-noncommercial 4 | (?:Creative Commons )?Attribution-Non-?Commercial 4\.0(?: International)?
7 | CC-BY-NC-3.0 | attribution-noncommercial 3 | (?:Creative Commons )?Attribution-Non-?Commercial 3\.0(?: Unported)?
7 | CC-BY-ND-4.0 | attribution-noderiv | (?:Creative Commons )?Attribution-NoDerivs?(?:atives)? 4\.0(?: International)?
7 | CC-BY-ND-3.0 | attribution-noderiv | (?:Creative Commons )?Attribution-NoDerivs?(?:atives)? 3\.0(?: Unported)?
7 | CC-BY-SA-4.0 | attribution-sharealike 4 | (?:Creative Commons )?Attribution-ShareAlike 4\.0(?: International)?
7 | CC-BY-SA-3.0 | attribution-sharealike 3 | (?:Creative Commons )?Attribution-ShareAlike 3\.0(?: Unported)?
7 | CC-BY-SA-2.5 | attribution-sharealike 2.5 | (?:Creative Commons )?Attribution-ShareAlike 2\.5
7 | CC-BY-SA-2.0 | attribution-sharealike 2.0 | (?:Creative Commons )?Attribution-ShareAlike 2\.0
6 | CC-BY-4.0 | attribution 4.0 | (?:Creative Commons )?Attribution 4\.0(?: International)?
6 | CC-BY-3.0 | attribution 3.0 | (?:Creative Commons )?Attribution 3\.0(?: Unported)?
6 | CC-BY-2.5 | attribution 2.5 | Creative Commons Attribution 2\.5
6 | CC-BY-2.0 | attribution 2.0 | Creative Commons Attribution 2\.0
7 | CC-BY-NC-SA-4.0 | cc by-nc-sa | \bCC[ -]BY-NC-SA[ -]4\.0
7 | CC-BY-NC-SA-3.0 | cc by-nc-sa | \bCC[ -]BY-NC-SA[ -]3\.0
7 | CC-BY-NC-ND-4.0 | cc by-nc-nd | \bCC[ -]BY-NC-ND[ -]4\.0
7 | CC-BY-NC-ND-3.0 | cc by-nc-nd | \bCC[ -]BY-NC-ND[ -]3\.0
7 | CC-BY-NC-4.0 | cc by-nc | (?:licensed under |released under |under )?(?:the )?\bCC[ -]BY-NC[ -]4\.0
7 | CC-BY-NC-3.0 | cc by-nc | (?:licensed under |released under |under )?(?:the )?\bCC[ -]BY-NC[ -]3\.0
7 | CC-BY-NC-2.0 | cc by-nc | \bCC[ -]BY-NC[ -]2\.0
7 | CC-BY-ND-4.0 | cc by-nd | \bCC[ -]BY-ND[ -]4\.0
7 | CC-BY-ND-3.0 | cc by-nd | \bCC[ -]BY-ND[ -]3\.0
7 | CC-BY-SA-4.0 | cc by-sa | (?:licensed under |released under |under )?(?:the )?\bCC[ -]BY-SA[ -]4\.0
7 | CC-BY-SA-3.0 | cc by-sa | (?:licensed under |released under |under )?(?:the )?\bCC[ -]BY-SA[ -]3\.0
7 | CC-BY-SA-2.5 | cc by-sa | \bCC[ -]BY-SA[ -]2\.5
7 | CC-BY-4.0 | cc by 4.0 | (?:licensed under |released under |under )?(?:the )?\bCC BY 4\.0
7 | CC-BY-3.0 | cc by 3.0 | (?:licensed under |released under |under )?(?:the )?\bCC BY 3\.0
7 | CC-BY-4.0 | cc-by-4.0 | \bCC-BY-4\.0
7 | CC-BY-3.0 | cc-by-3.0 | \bCC-BY-3\.0
7 | CC-BY-NC-4.0 | cc-by-nc-4.0 | \bCC-BY-NC-4\.0
7 | CC-BY-SA-4.0 | cc-by-sa-4.0 | \bCC-BY-SA-4\.0
7 | CC-BY-NC-SA-4.0 | cc-by-nc-sa-4.0 | \bCC-BY-NC-SA-4\.0
7 | CC-BY-NC-ND-4.0 | cc-by-nc-nd-4.0 | \bCC-BY-NC-ND-4\.0
5 | CC-BY-NC | cc by-nc | \bCC[ -]BY-NC(?:-SA|-ND)?\b
5 | CC-BY-SA | cc by-sa | \bCC[ -]BY-SA\b
5 | CC-BY-ND | cc by-nd | \bCC[ -]BY-ND\b
5 | CC-BY | cc by | \bCC[ -]BY\b
5 | CC | creative commons | \bCreative Commons(?: [A-Za-z\-]+)? licen[sc]e\b
5 | CC-PDM-1.0 | public domain mark | \bPublic Domain Mark(?: 1\.0)?\b
4 | CC-BY-NC-ND | creativecommons.org/licenses/by-nc-nd | creativecommons\.org/licenses/by-nc-nd(?:/[0-9.]+)?
4 | CC-BY-NC-SA | creativecommons.org/licenses/by-nc-sa | creativecommons\.org/licenses/by-nc-sa(?:/[0-9.]+)?
4 | CC-BY-NC | creativecommons.org/licenses/by-nc/ | creativecommons\.org/licenses/by-nc/(?:[0-9.]+)?
4 | CC-BY-ND | creativecommons.org/licenses/by-nd | creativecommons\.org/licenses/by-nd(?:/[0-9.]+)?
4 | CC-BY-SA | creativecommons.org/licenses/by-sa | creativecommons\.org/licenses/by-sa(?:/[0-9.]+)?
4 | CC-BY | creativecommons.org/licenses/by/ | creativecommons\.org/licenses/by/(?:[0-9.]+)?
4 | CC0-1.0 | creativecommons.org/publicdomain/zero | creativecommons\.org/publicdomain/zero(?:/1\.0)?
4 | Apache-2.0 | apache.org/licenses/license-2.0 | (?:https?://)?(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.txt|\.html)?
4 | MPL-2.0 | mozilla.org/mpl/2.0 | (?:https?://)?(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0/?
4 | MPL-1.1 | mozilla.org/mpl/mpl-1.1 | (?:https?://)?(?:www\.)?mozilla\.org/MPL/MPL-1\.1(?:\.html)?
4 | EPL-2.0 | eclipse.org/legal/epl-2.0 | (?:https?://)?(?:www\.)?eclipse\.org/legal/epl-2\.0/?
4 | EPL-1.0 | eclipse.org/legal/epl-v10 | (?:https?://)?(?:www\.)?eclipse\.org/legal/epl-v10(?:\.html)?
4 | MIT | opensource.org/licenses/mit | (?:https?://)?(?:www\.)?opensource\.org/licenses?/MIT(?:-license)?(?:\.php)?
4 | BSD | opensource.org/licenses/bsd | (?:https?://)?(?:www\.)?opensource\.org/licenses?/BSD-[0-9]-Clause
4 | GPL | gnu.org/licenses/gpl | (?:https?://)?(?:www\.)?gnu\.org/(?:licenses|copyleft)/gpl(?:-[123]\.0)?(?:\.html|\.txt)?
4 | LGPL | gnu.org/licenses/lgpl | (?:https?://)?(?:www\.)?gnu\.org/licenses/lgpl(?:-[23]\.[01])?(?:\.html|\.txt)?
4 | AGPL | gnu.org/licenses/agpl | (?:https?://)?(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?(?:\.html|\.txt)?
4 | GPL | gnu.org/licenses/ | (?:https?://)?(?:www\.)?gnu\.org/licenses/
4 | SPDX | spdx.org/licenses/ | (?:https?://)?spdx\.org/licenses/[A-Za-z0-9.+\-]+
6 | BSL-1.0 | boost software license | Boost Software License(?: ?-)?,? (?:version|v\.?)? ?1\.0
5 | BSL-1.0 | boost software license | \bBoost Software License\b
6 | BUSL-1.1 | business source license | Business Source License(?:,? (?:version|v\.?)? ?1\.1)?
6 | Zlib | zlib license | \b(?:the )?zlib(?:/libpng)? Licen[sc]e\b
8 | Zlib | in no event will the authors be held liable | In no event will the authors? be held liable for any damages arising from the use of this software
6 | libpng | libpng license | \blibpng Licen[sc]e(?: version 2)?\b
6 | Unlicense | the unlicense | \bThe Unlicense\b
8 | Unlicense | free and unencumbered software | This is free and unencumbered software released into the public domain
6 | WTFPL | wtfpl | \bWTFPL\b
8 | WTFPL | do what the fuck you want | DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
8 | Beerware | the beer-ware license | THE BEER-WARE LICENSE(?:" \(Revision 42\))?
6 | Artistic-2.0 | artistic license | \bArtistic License,? \(?(?:version|v\.?)? ?2\.0\)?
6 | Artistic-1.0 | artistic license | \bArtistic License,? \(?(?:version|v\.?)? ?1\.0\)?
5 | Artistic | artistic license | \b(?:Perl )?Artistic License\b
7 | Artistic-or-GPL | same terms as perl itself | under the same terms as Perl itself
6 | PSF-2.0 | python software foundation license | \bPython Software Foundation License(?:,? (?:version|v\.?) ?2)?
6 | PSF-2.0 | psf license | \bPSF Licen[sc]e(?: agreement)?\b
6 | Ruby | ruby license | \bRuby License\b
6 | PHP-3.01 | php license | \bPHP License,? (?:version|v\.?)? ?3\.01
5 | PHP | php license | \bPHP License\b
6 | PostgreSQL | postgresql licen | \bPostgreSQL Licen[sc]e\b
6 | OpenSSL | openssl license | \bOpenSSL License\b
6 | NCSA | ncsa open source license | \b(?:University of Illinois/)?NCSA Open Source License\b
6 | OFL-1.1 | sil open font license | SIL Open Font License,? (?:version|v\.?)? ?1\.1
5 | OFL | open font license | \b(?:SIL )?Open Font License\b
6 | Ms-PL | microsoft public license | \bMicrosoft Public License(?: \(Ms-PL\))?
6 | Ms-RL | microsoft reciprocal license | \bMicrosoft Reciprocal License(?: \(Ms-RL\))?
6 | OSL-3.0 | open software license | \bOpen Software License,? \(?(?:version|v\.?)? ?3\.0\)?
6 | AFL-3.0 | academic free license | \bAcademic Free License,? \(?(?:version|v\.?)? ?3\.0\)?
6 | AFL-2.1 | academic free license | \bAcademic Free License,? \(?(?:version|v\.?)? ?2\.1\)?
6 | CECILL-2.1 | cecill | \bCeCILL(?:-2\.1| (?:version|v\.?)? ?2\.1)
5 | CECILL | cecill | \bCeCILL(?:-[BC])?\b
6 | ECL-2.0 | educational community license | \bEducational Community License,? (?:version|v\.?)? ?2\.0
6 | UPL-1.0 | universal permissive license | \bUniversal Permissive License(?:,? \(?UPL\)?)?(?:,? (?:version|v\.?)? ?1\.0)?
6 | IPL-1.0 | ibm public license | \bIBM Public License(?:,? (?:version|v\.?)? ?1\.0)?
6 | QPL-1.0 | q public license | \bQ Public License(?:,? (?:version|v\.?)? ?1\.0)?
6 | RPL-1.5 | reciprocal public license | \bReciprocal Public License(?:,? (?:version|v\.?)? ?1\.5)?
6 | SSPL-1.0 | server side public license | \bServer Side Public License(?:,? (?:version|v\.?)? ?1)?
6 | Elastic-2.0 | elastic license | \bElastic License(?:,? (?:version|v\.?)? ?2(?:\.0)?)?
6 | Sleepycat | sleepycat license | \bSleepycat License\b
6 | Vim | vim license | \bVim License\b
6 | ZPL-2.1 | zope public license | \bZope Public License(?:,? \(?ZPL\)?)?(?:,? (?:version|v\.?)? ?2\.1)?
6 | W3C | w3c software | \bW3C Software (?:and Document )?(?:Notice and )?License\b
6 | Unicode-DFS | unicode, inc. license | \bUnicode,? Inc\.? License Agreement\b
6 | ICU | icu license | \bICU License\b
6 | FTL | freetype project license | \bFreeType Project License\b
6 | IJG | independent jpeg group | \bthe work of the Independent JPEG Group\b
6 | curl | curl license | \bcurl License\b
6 | JSON | shall be used for good, not evil | The Software shall be used for Good, not Evil
6 | TCL | tcl/tk license | \bTcl/Tk License\b
6 | BlueOak-1.0.0 | blue oak model license | \bBlue Oak Model License(?: 1\.0\.0)?
6 | MulanPSL-2.0 | mulan permissive software license | \bMulan Permissive Software License,? (?:version|v\.?) ?2
6 | ODbL-1.0 | open database license | \bOpen Database License(?: \(ODbL\))?(?:,? v?1\.0)?
6 | ODC-By-1.0 | open data commons attribution | \bOpen Data Commons Attribution License(?:,? v?1\.0)?
6 | PDDL-1.0 | public domain dedication and licen | \bPublic Domain Dedication and Licen[sc]e\b
6 | OGL-UK-3.0 | open government licence | \bOpen Government Licence(?: v?3\.0)?
6 | OpenRAIL | openrail | \b(?:Creative ML )?Open ?RAIL(?:-M|\+\+-M|-S)?(?: licen[sc]e)?\b
6 | Llama | community license agreement | \b[A-Z]\w+ ?[0-9.]* COMMUNITY LICENSE AGREEMENT\b
6 | PolyForm-Noncommercial | polyform noncommercial | \bPolyForm Noncommercial(?: License)?(?: 1\.0\.0)?
6 | PolyForm | polyform | \bPolyForm (?:Small Business|Shield|Strict|Perimeter|Free Trial|Internal Use)(?: License)?(?: 1\.0\.0)?
6 | Commons-Clause | commons clause | \bCommons Clause(?: License Condition)?(?: v1\.0)?
6 | Hippocratic | hippocratic license | \bHippocratic License(?: [0-9.]+)?
6 | Parity | parity public license | \bParity Public License(?: [0-9.]+)?
5 | public-domain | public domain | \b(?:released|dedicated|placed|put) (?:in|in ?to) the public domain\b
5 | public-domain | public domain | \bthis (?:work|file|code|software|document) is (?:hereby )?(?:in|released into) the public domain\b
3 | proprietary | all rights reserved | \bAll rights reserved\b\.?
5 | proprietary | proprietary and confidential | \bproprietary and confidential\b
5 | proprietary | unauthorized copying of this file | Unauthorized copying of this file,? via any medium,? is strictly prohibited
5 | proprietary | commercial license | \bunder (?:a|the) commercial licen[sc]e\b
3 | copyright | copyright | \bCopyright (?:\(c\)|©)? ?(?:[0-9]{4}(?: ?[-–,] ?[0-9]{4})*)(?:,? (?:by )?[^\n]{1,80})?
3 | copyright | © | © ?(?:[0-9]{4}(?: ?[-–,] ?[0-9]{4})*)(?:,? (?:by )?[^\n]{1,80})?
2 | hint | see the license | see the LICENSE(?:\.txt|\.md)?(?: file)? for (?:more )?(?:details|information)
2 | hint | license.txt | \bLICENSE\.(?:txt|md|rst)\b
2 | hint | dual-licensed | \bdual[- ]licensed\b
2 | hint | licensed under | \blicensed under (?:the )?[^\n.]{1,60}
2 | hint | licence | \blicen[cs]ed under (?:the )?[^\n.]{1,40} licence\b
"""

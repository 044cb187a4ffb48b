"""Hand-written licence signatures.

A line is ``level label | keyword | regex``. Texts are lower-cased words joined by single spaces, so
``apache-2.0`` reads ``apache 2 0``. A regex matches whole words. It is tried only where the keyword
occurs. Levels in order of priority: 1 identifiers and licence texts, 2 notices, 3 names, 4 hints.
"""

RULES = r"""
1 mit | spdx | spdx license identifier mit( 0)?
1 mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
1 mit | above copyright notice and this permission | the above copyright notice and this permission notice (\(including the next paragraph\) )?shall be included in all copies
1 mit | without restriction including | deal in the software without restriction including without limitation the rights to use
2 mit | mit licen | (licensed|released|distributed|available|provided|published) under (the |an )?(terms of the )?mit licen[cs]e
2 mit | mit x11 | (licensed|released|distributed) under (the )?mit x11( licen[cs]e)?
2 mit | mit style | mit style licen[cs]e
3 mit | mit licen | (the )?mit licen[cs]e(s|d)?
3 mit | expat | expat licen[cs]e
3 mit | opensource org | opensource org licenses mit( license php)?
3 mit | x11 licen | x11 licen[cs]e
4 mit | license mit | license mit
1 apache | spdx | spdx license identifier apache 2 0( with llvm exception)?
1 apache | apache license version | licensed under the apache license version 2 0 the license
1 apache | you may not use this file except | you may not use this file except in compliance with the license
1 apache | on an as is basis without warranties | distributed on an as is basis without warranties or conditions of any kind either express or implied
1 apache | grant of patent license | grant of patent license subject to the terms and conditions of this license
1 apache | terms and conditions for use reproduction | terms and conditions for use reproduction and distribution
2 apache | apache | (licensed|released|distributed|available|provided) under (the )?(terms of the )?apache( software)?( license)?( version)?( v)? ?2( 0)?
2 apache | apache software foundation | licensed to the apache software foundation asf
3 apache | apache | apache( software)? licen[cs]e( version| v)? ?(1 0|1 1|2 0|2)
3 apache | apache licen | apache licen[cs]e(s|d)?
3 apache | apache | apache 2( 0)? licen[cs]e
3 apache | apache org licenses | apache org licenses license 2 0( txt| html)?
4 apache | license apache | license apache( 2 0)?
4 apache | asl 2 | asl 2( 0)?
1 gpl | spdx | spdx license identifier a?gpl [123]( 0)?( only| or later| plus)?
1 gpl | free software you can redistribute | (this program|it|this library|this file) is free software you can redistribute it and or modify it under the terms of the gnu general public license
1 gpl | gnu general public license | you should have received a copy of the gnu general public license along with this program
1 gpl | either version | gnu general public license as published by the free software foundation either version [123]
1 gpl | copyleft license for software | the gnu general public license is a free copyleft license for software
2 gpl | general public licen | (licensed|released|distributed|available) under (the )?(terms of the )?(gnu )?general public licen[cs]e
2 gpl | gpl | (licensed|released|distributed|available) under (the )?(terms of the )?(gnu )?gpl( v)?( ?[123])?( 0)?( or later)?
3 gpl | general public licen | (gnu )?general public licen[cs]e( version| v)?( [123])?( 0)?
3 gpl | gpl | (gnu )?gpl( version| v| 2 0| 3 0)( [123])?( 0)?( or later| only)?
3 gpl | gplv | (gnu )?gplv[123]( only| or later)?
3 gpl | gnu org licenses | gnu org licenses (old licenses )?gpl( [23] 0)?( html| txt)?
3 gpl | gnu gpl | gnu gpl
3 gpl | gpl licen | gpl licen[cs]e(d)?
4 gpl | license gpl | license gpl
1 lgpl | spdx | spdx license identifier lgpl [23]( [01])?( only| or later)?
1 lgpl | lesser general public license | under the terms of the gnu lesser general public license as published by the free software foundation
1 lgpl | library general public license | under the terms of the gnu library general public license as published by the free software foundation
2 lgpl | lgpl | (licensed|released|distributed) under (the )?(terms of the )?(gnu )?lgpl( v)?( ?[23])?( [01])?
3 lgpl | lesser general public licen | (gnu )?lesser general public licen[cs]e( version| v)?( [23])?( [01])?
3 lgpl | library general public licen | (gnu )?library general public licen[cs]e( version)?( 2)?
3 lgpl | lgplv | (gnu )?lgplv[23]( [01])?
3 lgpl | gnu org licenses lgpl | gnu org licenses lgpl( html| txt)?
3 lgpl | lgpl | (gnu )?lgpl( version| v)?( [23])?( [01])? (licen[cs]e(d)?|or later|only)
1 agpl | spdx | spdx license identifier agpl [13] 0( only| or later)?
1 agpl | affero general public license | under the terms of the gnu affero general public license as published by the free software foundation
2 agpl | agpl | (licensed|released|distributed) under (the )?(terms of the )?(gnu )?agpl( v)?( ?3)?( 0)?
3 agpl | affero general public licen | (gnu )?affero general public licen[cs]e( version| v)?( [13])?( 0)?
3 agpl | agplv | (gnu )?agplv[13]( only| or later)?
3 agpl | gnu agpl | gnu agpl
1 bsd | spdx | spdx license identifier (0|bsd [1234]) ?(bsd|clause)( clear| patent| lbnl)?
1 bsd | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 bsd | redistributions of source code must | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
1 bsd | redistributions in binary form must | redistributions in binary form must reproduce the above copyright notice
1 bsd | endorse or promote products | neither the name of .{1,80}? may be used to endorse or promote products derived from this software
1 bsd | all advertising materials mentioning | all advertising materials mentioning features or use of this software must display
2 bsd | bsd | (licensed|released|distributed|available) under (the |a )?(terms of the )?((new|modified|simplified|revised|[234] clause|three clause|two clause) )?bsd
2 bsd | bsd style | governed by a bsd style license that can be found in the license file
3 bsd | bsd licen | ((new|modified|simplified|revised|original) )?bsd licen[cs]e(s|d)?
3 bsd | bsd | bsd [1234] clause( licen[cs]e)?
3 bsd | clause bsd | (1|2|3|4|two|three|four|zero) clause bsd( licen[cs]e)?
3 bsd | bsd style | bsd style( licen[cs]e)?
3 bsd | opensource org licenses bsd | opensource org licenses bsd( [23] clause| license php)?
4 bsd | license bsd | license bsd
1 isc | spdx | spdx license identifier isc
1 isc | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc | isc licen | (licensed|released|distributed) under (the )?isc licen[cs]e
3 isc | isc licen | isc licen[cs]e(d)?
1 mpl | spdx | spdx license identifier mpl [12] [01]
1 mpl | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
1 mpl | mozilla public license version | the contents of this file are subject to the mozilla public license version 1 [01]
2 mpl | mozilla public licen | (licensed|released|distributed) under (the )?(terms of the )?mozilla public licen[cs]e
3 mpl | mozilla public licen | mozilla public licen[cs]e( version| v)?( [12])?( [01])?
3 mpl | mozilla org mpl | mozilla org mpl( [12] [01])?
3 mpl | mpl | mpl [12] [01]
3 mpl | mplv | mplv2
1 epl | spdx | spdx license identifier epl [12] 0
1 epl | eclipse public license | made available under the terms of the eclipse public license( v| version)? ?[12] 0
3 epl | eclipse public licen | eclipse public licen[cs]e( version| v)?( [12])?( 0)?
3 epl | eclipse org legal | eclipse org legal epl (v10|2 0|v20)( html)?
3 epl | eclipse distribution licen | eclipse distribution licen[cs]e( v)?( 1 0)?
1 cddl | spdx | spdx license identifier cddl 1 [01]
1 cddl | common development and distribution | subject to the terms of the common development and distribution license
3 cddl | common development and distribution | common development and distribution licen[cs]e( version)?( 1 [01])?
3 cddl | cddl | cddl( v)? ?1 [01]
1 unlicense | spdx | spdx license identifier unlicense
1 unlicense | unencumbered software released into | this is free and unencumbered software released into the public domain
3 unlicense | unlicense | (the )?unlicense
3 unlicense | unlicense org | unlicense org
1 public-domain | public domain | (released|placed|dedicated|put) (in|into|to) the public domain
1 public-domain | public domain | (this (work|software|file|text|document) is|these works are) (in|part of) the public domain
1 public-domain | disclaims copyright | the author disclaims copyright to this source code
2 public-domain | public domain | public domain (dedication|mark|work|notice)
3 public-domain | public domain | (in the )?public domain
3 public-domain | no known copyright | no known copyright restrictions
1 cc0 | spdx | spdx license identifier cc0 1 0
1 cc0 | waived all copyright | has waived all copyright and related or neighboring rights
2 cc0 | cc0 | (licensed|released|available|dedicated) under (the )?cc0
3 cc0 | cc0 | cc0( 1 0)?( universal)?
3 cc0 | publicdomain zero | creativecommons org publicdomain zero 1 0
3 cc0 | creative commons zero | creative commons zero( v1 0)?( universal)?
1 cc-by | spdx | spdx license identifier cc by [1234] [05]
2 cc-by | cc by | (licensed|released|available|shared|published) under (a |the )?cc by( [1234] [05])?
2 cc-by | creative commons attribution | (licensed|released|available|shared|published) under (a |the )?creative commons attribution( [1234] [05])?( international| unported| generic)? licen[cs]e
3 cc-by | cc by | cc by( [1234] [05])?
3 cc-by | creative commons attribution | creative commons attribution( [1234] [05])?( international| unported| generic)?( licen[cs]e)?
3 cc-by | licenses by | creativecommons org licenses by [1234] [05]
1 cc-by-sa | spdx | spdx license identifier cc by sa [1234] [05]
2 cc-by-sa | cc by sa | (licensed|released|available|shared|published) under (a |the )?cc by sa( [1234] [05])?
2 cc-by-sa | share | (licensed|released|available) under (a |the )?creative commons attribution share ?alike( [1234] [05])?
3 cc-by-sa | cc by sa | cc by sa( [1234] [05])?
3 cc-by-sa | creative commons attribution | creative commons attribution share ?alike( [1234] [05])?( international| unported)?( licen[cs]e)?
3 cc-by-sa | licenses by sa | creativecommons org licenses by sa [1234] [05]
1 cc-by-nc | spdx | spdx license identifier cc by nc [1234] [05]
2 cc-by-nc | cc by nc | (licensed|released|available|shared|published) under (a |the )?cc by nc( [1234] [05])?
3 cc-by-nc | cc by nc | cc by nc( [1234] [05])?
3 cc-by-nc | creative commons attribution | creative commons attribution non ?commercial( [1234] [05])?( international| unported)?( licen[cs]e)?
3 cc-by-nc | licenses by nc | creativecommons org licenses by nc [1234] [05]
1 cc-by-nc-sa | spdx | spdx license identifier cc by nc sa [1234] [05]
2 cc-by-nc-sa | cc by nc sa | (licensed|released|available|shared) under (a |the )?cc by nc sa( [1234] [05])?
3 cc-by-nc-sa | cc by nc sa | cc by nc sa( [1234] [05])?
3 cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike( [1234] [05])?
3 cc-by-nc-sa | licenses by nc sa | creativecommons org licenses by nc sa [1234] [05]
1 cc-by-nc-nd | spdx | spdx license identifier cc by nc nd [1234] [05]
3 cc-by-nc-nd | cc by nc nd | cc by nc nd( [1234] [05])?
3 cc-by-nc-nd | creative commons attribution | creative commons attribution non ?commercial no ?deriv(ative)?s( works)?( [1234] [05])?
3 cc-by-nc-nd | licenses by nc nd | creativecommons org licenses by nc nd [1234] [05]
1 cc-by-nd | spdx | spdx license identifier cc by nd [1234] [05]
3 cc-by-nd | cc by nd | cc by nd( [1234] [05])?
3 cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(ative)?s( works)?( [1234] [05])?
3 cc-by-nd | licenses by nd | creativecommons org licenses by nd [1234] [05]
4 creative-commons | creative commons | creative commons( licen[cs]e)?
4 creative-commons | creativecommons org | creativecommons org
1 gfdl | spdx | spdx license identifier gfdl 1 [123]( only| or later)?
1 gfdl | free documentation license | under the terms of the gnu free documentation license
3 gfdl | free documentation licen | (gnu )?free documentation licen[cs]e( version)?( 1 [123])?
3 gfdl | gfdl | (gnu )?gfdl( 1 [123])?
1 zlib | spdx | spdx license identifier zlib
1 zlib | origin of this software must not | the origin of this software must not be misrepresented
2 zlib | zlib licen | (licensed|released|distributed) under (the )?zlib( libpng)? licen[cs]e
3 zlib | zlib | zlib( libpng)? licen[cs]e
1 boost | spdx | spdx license identifier bsl 1 0
1 boost | boost software license | distributed under the boost software license version 1 0
3 boost | boost software licen | boost software licen[cs]e( version)?( 1 0)?
3 boost | license 1 0 txt | boost org license 1 0 txt
1 wtfpl | spdx | spdx license identifier wtfpl
1 wtfpl | what the fuck you want | do what the fuck you want to( public license)?
3 wtfpl | wtfpl | wtfpl( v2)?
1 artistic | spdx | spdx license identifier artistic [12] 0( perl| cl8)?
2 artistic | under the same terms as perl | you can redistribute it and or modify it under the same terms as perl itself
3 artistic | artistic licen | (perl )?artistic licen[cs]e( version)?( [12])?( 0)?
1 python | spdx | spdx license identifier (python|psf) 2 0
1 python | psf license agreement | psf license agreement for python
3 python | python software foundation licen | python software foundation licen[cs]e( version)?( 2)?
3 python | psf licen | psf licen[cs]e
1 openssl | openssl project for use | this product includes software developed by the openssl project for use in the openssl toolkit
3 openssl | openssl licen | openssl licen[cs]e
3 openssl | ssleay licen | ssleay licen[cs]e
1 php | php software | this product includes php software
3 php | php licen | php licen[cs]e( version)?( 3 0[01]?)?
1 ruby | spdx | spdx license identifier ruby
3 ruby | ruby licen | ruby licen[cs]e
2 ruby | under the same terms as ruby | under the same terms as ruby( itself)?
1 ofl | spdx | spdx license identifier ofl 1 [01]
1 ofl | sil open font license | licensed under the sil open font license version 1 [01]
3 ofl | open font licen | (sil )?open font licen[cs]e( version)?( 1 [01])?
3 ofl | scripts sil org ofl | scripts sil org ofl
1 eupl | spdx | spdx license identifier eupl 1 [012]
2 eupl | eupl | (licensed|released) under (the )?eupl( version)?( 1 [012])?
3 eupl | european union public licen | european union public licen[cs]e( version| v)?( 1)?( [012])?
3 eupl | eupl | eupl( v)? ?1 [012]
1 odbl | spdx | spdx license identifier odbl 1 0
2 odbl | open database licen | (licensed|available) under (the )?(odc )?open database licen[cs]e
3 odbl | open database licen | (odc )?open database licen[cs]e( v)?( 1 0)?
3 odbl | odbl | odbl( 1 0)?
3 odc-by | open data commons attribution | open data commons attribution licen[cs]e( v)?( 1 0)?
3 pddl | public domain dedication and licen | (open data commons )?public domain dedication and licen[cs]e
1 ms-pl | spdx | spdx license identifier ms pl
3 ms-pl | microsoft public licen | microsoft public licen[cs]e( ms pl)?
3 ms-rl | microsoft reciprocal licen | microsoft reciprocal licen[cs]e( ms rl)?
3 ibm-pl | ibm public licen | ibm public licen[cs]e( version)?( 1 0)?
3 cpl | common public licen | common public licen[cs]e( version| v)?( 1 0)?
3 cpal | common public attribution licen | common public attribution licen[cs]e( version)?( 1 0)?
3 osl | open software licen | open software licen[cs]e( version| v)?( [123] [01])?
3 afl | academic free licen | academic free licen[cs]e( version| v)?( [123] [01])?
3 apsl | apple public source licen | apple public source licen[cs]e( version)?( [12] [01])?
3 qpl | q public licen | q public licen[cs]e( version)?( 1 0)?
3 npl | netscape public licen | netscape public licen[cs]e( version)?( 1 [01])?
3 spl | sun public licen | sun public licen[cs]e( version)?( 1 0)?
3 lppl | latex project public licen | latex project public licen[cs]e( version)?( 1 3)?c?
3 postgresql | postgresql licen | postgresql licen[cs]e
3 ncsa | ncsa open source licen | (university of illinois )?ncsa open source licen[cs]e
3 upl | universal permissive licen | universal permissive licen[cs]e( version| v)?( 1 0)?
3 vim | vim licen | vim licen[cs]e
3 beerware | beerware | beerware( licen[cs]e)?
1 beerware | buy me a beer | you can buy me a beer in return
3 sleepycat | sleepycat licen | sleepycat licen[cs]e
3 sspl | server side public licen | server side public licen[cs]e( v| version)?( 1)?
3 busl | business source licen | business source licen[cs]e( 1 1)?
3 elastic | elastic licen | elastic licen[cs]e( 2 0| v2)?
3 polyform | polyform | polyform (noncommercial|small business|strict|shield|perimeter)( license)?( 1 0 0)?
3 openrail | openrail | (creativeml |bigscience )?openrail( m| rail)?( licen[cs]e)?
3 llama | llama | llama( [23])? community licen[cs]e( agreement)?
1 proprietary | all rights reserved | all rights (are )?reserved
1 proprietary | proprietary and confidential | (this (file|software|document|code) is )?proprietary and confidential
1 proprietary | unauthorized copying | unauthorized copying of this (file|software|document|work)
1 proprietary | be reproduced | (no part of this|this) .{1,60}? may (not )?be reproduced( .{1,60}?)? without (the )?(prior )?(written )?permission
2 proprietary | no part of this | no part of this (book|publication|work|document) may be
2 proprietary | trade secret | contains (confidential|proprietary) (information|material) and trade secrets
2 proprietary | end user licen | end user licen[cs]e agreement
3 proprietary | proprietary licen | proprietary licen[cs]e(d)?
3 proprietary | commercial licen | commercial licen[cs]e(d)?
3 proprietary | eula | eula
3 freeware | freeware | freeware( licen[cs]e)?
3 shareware | shareware | shareware( licen[cs]e)?
4 copyright | copyright | copyright (c )?(19|20)[0-9]{2}( (19|20)[0-9]{2})?
4 copyright | copyright | (c )?copyright (by|holder|holders|owner|notice)
4 warranty | as is | (provided )?as is without (any )?(express or implied )?warranty( of any kind)?
4 warranty | warranty | without (even the implied )?warranty of (merchantability|any kind)
4 unknown | licensed under | licensed under( the| a| an)?( terms of)?
4 unknown | licen | see (the )?licen[cs]e( file)?( for details)?
4 unknown | licen | licen[cs]e (file|txt|md)
""".strip()

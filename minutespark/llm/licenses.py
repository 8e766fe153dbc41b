"""License scan by ordered signature rules, in DataFrame functions alone.

A text becomes its words (letters and digits, A-Z lowered) between single blanks.
Rules are regexes over such words, written out one by one in ``RULES``; each is a
constant of the plan, compiled once a task.  Each has a tier (its priority; earlier
rules of a tier come first) and a keyword that every match holds at the start of a
word: only documents that hold some keyword are looked at, and only the rules of the
keywords they hold are tried on them.  Of overlapping detections, one whose interval
lies within that of a detection of the same or a better tier is dropped.

Three plain phrases are always reported, whatever the rules find.

Null and empty texts have no words and no labels.  Repeated rows and null ids are
scanned each; an empty table gives no rows.  Time grows with a text's length and its
matches, not with their square.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, require

#: Plain phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: tier, label :: keyword :: regex over words.  Tier 1: clauses of a license's own text;
#: 2: a license that is granted or tagged; 3: a name or mention.
RULES = r"""
1 mit :: permission is hereby granted :: permission is hereby granted free of charge to any person obtaining a copy of this software
1 mit :: permission notice :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 mit :: the software is provided :: the software is provided as is without warranty of any kind express or implied
1 mit-0 :: permission is hereby granted :: permission is hereby granted free of charge to any person obtaining a copy of this software(?: [^ ]+){1,60} to whom the software is furnished to do so the software is provided
1 x11 :: shall not be used :: except as contained in this notice the name (?:of )?(?:[^ ]+ ){1,10}shall not be used in advertising or otherwise to promote
1 isc :: permission to use :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 0bsd :: permission to use :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
1 hpnd :: permission to use :: permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
1 ntp :: permission to use :: permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
1 postgresql :: permission to use :: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 bsd-2 :: redistribution and use :: redistribution and use in source and binary forms with or without modification are permitted
1 bsd-2 :: redistributions of source :: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
1 bsd-3 :: neither the name :: neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|any|their|other) contributors may be used to endorse
1 bsd-3 :: may not be used to endorse :: the names? of (?:[^ ]+ ){1,12}may not be used to endorse or promote products derived from this software
1 bsd-4 :: all advertising materials :: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
1 bsd-3-clear :: no express or implied licenses :: no express or implied licenses to any party s patent rights are granted by this license
1 apache-2 :: licensed under the apache :: licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file
1 apache-2 :: in compliance with the licen :: you may not use this file except in compliance with the licen[cs]e
1 apache-2 :: limitations under the licen :: see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
1 apache-2 :: apache licen :: apache licen[cs]e version 2 0 january 2004
1 apache-1-1 :: apache software foundation :: this product includes software developed by the apache software foundation
1 gpl-3 :: redistribute it and or modify :: redistribute it and or modify it under the terms of the gnu general public licen[cs]e(?: [^ ]+){1,14} version 3
1 gpl-2 :: redistribute it and or modify :: redistribute it and or modify it under the terms of the gnu general public licen[cs]e(?: [^ ]+){1,14} version 2
1 lgpl-3 :: redistribute it and or modify :: redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e(?: [^ ]+){1,14} version 3
1 lgpl-2-1 :: redistribute it and or modify :: redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e(?: [^ ]+){1,14} version 2(?: 1)?
1 agpl-3 :: redistribute it and or modify :: redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e(?: [^ ]+){1,14} version 3
1 gpl-3 :: gnu general public licen :: gnu general public licen[cs]e version 3 29 june 2007
1 gpl-2 :: gnu general public licen :: gnu general public licen[cs]e version 2 june 1991
1 lgpl-2-1 :: gnu lesser general public licen :: gnu lesser general public licen[cs]e version 2 1 february 1999
1 agpl-3 :: gnu affero general public licen :: gnu affero general public licen[cs]e version 3 19 november 2007
1 gpl :: without even the implied warranty :: but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e
1 lgpl :: without even the implied warranty :: but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public licen[cs]e
1 gfdl-1-3 :: gnu free documentation licen :: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 3
1 gfdl-1-2 :: gnu free documentation licen :: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 2
1 gpl-linking-exception :: as a special exception :: as a special exception (?:[^ ]+ ){1,40}link(?:ing)? (?:this|the) (?:library|program|code)
1 zlib :: this software is provided as is :: this software is provided as is without any express or implied warranty
1 zlib :: altered source versions :: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
1 libpng :: png reference library :: this copy of the libpng notices is provided for your convenience(?: [^ ]+){1,60} png reference library
1 unlicense :: free and unencumbered :: free and unencumbered software released into the public domain
1 unlicense :: anyone is free to copy :: anyone is free to copy modify publish use compile sell or distribute this software
1 mpl-2 :: this source code form :: this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
1 mpl-1-1 :: the contents of this file :: the contents of this file are subject to the mozilla public licen[cs]e version 1 1
1 mpl-2 :: incompatible with secondary licen :: this source code form is incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e
1 npl-1-1 :: the contents of this file :: the contents of this file are subject to the netscape public licen[cs]e version 1 1
1 cddl-1 :: the contents of this file :: the contents of this file are subject to the terms of the common development and distribution licen[cs]e
1 epl-2 :: this program and the accompanying :: this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version) ?2(?: 0)?
1 epl-1 :: this program and the accompanying :: this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version) ?1(?: 0)?
1 boost-1 :: boost software licen :: boost software licen[cs]e version 1 0 august 17th 2003
1 boost-1 :: distributed under the boost :: distributed under the boost software licen[cs]e version 1 0 see accompanying file
1 artistic-2 :: artistic licen :: everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document(?: [^ ]+){1,30} artistic licen[cs]e 2 0
1 wtfpl :: everyone is permitted to copy :: everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed
1 wtfpl :: you just do what :: you just do what the f[a-z]* you want to
1 beerware :: beer ware licen :: the beer ware licen[cs]e revision 42
1 beerware :: you can buy me a beer :: if we meet some day and you think this stuff is worth it you can buy me a beer
1 json :: shall be used for good :: the software shall be used for good not evil
1 ofl-1-1 :: this font software is licensed :: this font software is licensed under the sil open font licen[cs]e version 1 1
1 ofl-1-1 :: reserved font name :: with reserved font names?(?: [^ ]+){1,6}
1 psf-2 :: python software foundation :: this licen[cs]e agreement is between the python software foundation psf and the individual or organization
1 openssl :: openssl project :: this product includes software developed by the openssl project for use in the openssl toolkit
1 php-3 :: this product includes php :: this product includes php software freely available from
1 ncsa :: deal with the software :: to deal with the software without restriction including without limitation the rights to use copy modify merge publish
1 curl :: in this software without prior written :: the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
1 ijg :: independent jpeg group :: this software is based in part on the work of the independent jpeg group
1 ftl :: freetype project :: portions of this software are copyright(?: [^ ]+){1,4} the freetype project
1 unicode :: data files or software :: to deal in the data files or software without restriction
1 sspl-1 :: server side public licen :: server side public licen[cs]e version 1 october 16 2018
1 busl-1-1 :: business source licen :: business source licen[cs]e 1 1 (?:parameters|licensor|terms)
1 commons-clause :: commons clause :: the software is provided to you by the licensor under the licen[cs]e as defined below subject to the following condition(?: [^ ]+){0,12} commons clause
1 commons-clause :: right to sell the software :: the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software
1 elastic-2 :: hosted or managed service :: you may not provide the software to third parties as a hosted or managed service
1 cc0-1 :: to the extent possible under law :: to the extent possible under law (?:[^ ]+ ){1,14}waived all copyright and related or neighbou?ring rights
1 cc-by :: to view a copy of this licen :: to view a copy of this licen[cs]e visit (?:https? )?(?:www )?creativecommons org licen[cs]es by [1-4] 0
1 cc-by-sa :: to view a copy of this licen :: to view a copy of this licen[cs]e visit (?:https? )?(?:www )?creativecommons org licen[cs]es by sa [1-4] 0
1 cc-by-nc :: to view a copy of this licen :: to view a copy of this licen[cs]e visit (?:https? )?(?:www )?creativecommons org licen[cs]es by nc [1-4] 0
1 cc-by-nd :: to view a copy of this licen :: to view a copy of this licen[cs]e visit (?:https? )?(?:www )?creativecommons org licen[cs]es by nd [1-4] 0
1 cc-by-nc-sa :: to view a copy of this licen :: to view a copy of this licen[cs]e visit (?:https? )?(?:www )?creativecommons org licen[cs]es by nc sa [1-4] 0
1 cc-by-nc-nd :: to view a copy of this licen :: to view a copy of this licen[cs]e visit (?:https? )?(?:www )?creativecommons org licen[cs]es by nc nd [1-4] 0
1 odbl-1 :: open database licen :: this (?:[^ ]+ ){1,8}is made available under the open database licen[cs]e
1 odc-by-1 :: open data commons attribution :: this (?:[^ ]+ ){1,8}is made available under the open data commons attribution licen[cs]e
1 pddl-1 :: public domain dedication :: this (?:[^ ]+ ){1,8}is made available under the public domain dedication and licen[cs]e
1 ogl-uk-3 :: open government licen :: contains public sector information licensed under the open government licen[cs]e v ?3 0
1 fsf-permissive :: copying and distribution of this file :: copying and distribution of this file with or without modification are permitted in any medium without royalty
1 lppl-1-3 :: latex project public licen :: this work may be distributed and or modified under the conditions of the latex project public licen[cs]e
1 cecill-2 :: governed by the cecill :: this software is governed by the cecill licen[cs]e under french law
1 llama :: community licen :: llama (?:[23](?: [0-9])? )?is licensed under the (?:[^ ]+ ){0,4}community licen[cs]e
1 openrail :: use based restrictions :: use based restrictions (?:as )?referenced in (?:paragraph|section|attachment)
1 proprietary :: proprietary and confidential :: (?:unauthori[sz]ed copying of this file via any medium is strictly prohibited )?proprietary and confidential
1 proprietary :: trade secret :: (?:contains|is) (?:the )?(?:confidential (?:and proprietary )?information and )?trade secrets? of
2 mit :: spdx licen :: spdx licen[cs]e identifier mit
2 mit-0 :: spdx licen :: spdx licen[cs]e identifier mit 0
2 isc :: spdx licen :: spdx licen[cs]e identifier isc
2 0bsd :: spdx licen :: spdx licen[cs]e identifier 0bsd
2 bsd-2 :: spdx licen :: spdx licen[cs]e identifier bsd 2 clause
2 bsd-3 :: spdx licen :: spdx licen[cs]e identifier bsd 3 clause
2 bsd-4 :: spdx licen :: spdx licen[cs]e identifier bsd 4 clause
2 apache-2 :: spdx licen :: spdx licen[cs]e identifier apache 2 0
2 gpl-2 :: spdx licen :: spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
2 gpl-3 :: spdx licen :: spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
2 lgpl-2-1 :: spdx licen :: spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
2 lgpl-3 :: spdx licen :: spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
2 agpl-3 :: spdx licen :: spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
2 mpl-1-1 :: spdx licen :: spdx licen[cs]e identifier mpl 1 1
2 mpl-2 :: spdx licen :: spdx licen[cs]e identifier mpl 2 0
2 epl-1 :: spdx licen :: spdx licen[cs]e identifier epl 1 0
2 epl-2 :: spdx licen :: spdx licen[cs]e identifier epl 2 0
2 cddl-1 :: spdx licen :: spdx licen[cs]e identifier cddl 1 [01]
2 zlib :: spdx licen :: spdx licen[cs]e identifier zlib
2 boost-1 :: spdx licen :: spdx licen[cs]e identifier bsl 1 0
2 busl-1-1 :: spdx licen :: spdx licen[cs]e identifier busl 1 1
2 unlicense :: spdx licen :: spdx licen[cs]e identifier unlicense
2 wtfpl :: spdx licen :: spdx licen[cs]e identifier wtfpl
2 artistic-2 :: spdx licen :: spdx licen[cs]e identifier artistic 2 0
2 eupl-1-2 :: spdx licen :: spdx licen[cs]e identifier eupl 1 2
2 ofl-1-1 :: spdx licen :: spdx licen[cs]e identifier ofl 1 1
2 cc0-1 :: spdx licen :: spdx licen[cs]e identifier cc0 1 0
2 cc-by :: spdx licen :: spdx licen[cs]e identifier cc by [1-4] [05]
2 cc-by-sa :: spdx licen :: spdx licen[cs]e identifier cc by sa [1-4] [05]
2 cc-by-nc :: spdx licen :: spdx licen[cs]e identifier cc by nc [1-4] [05]
2 mit :: mit licen :: (?:licensed|released|distributed|available|provided|published|issued) under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
2 mit :: mit licen :: (?:subject to|governed by|covered by) (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
2 mit :: expat licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?expat licen[cs]e
2 x11 :: x11 licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?x11 licen[cs]e
2 isc :: isc licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc licen[cs]e
2 bsd :: bsd licen :: (?:licensed|released|distributed|available|provided) under (?:the |a )?(?:terms of (?:the )?)?bsd licen[cs]e
2 bsd :: bsd style :: (?:licensed|released|distributed|available|governed) (?:under|by) (?:the |a )?(?:terms of (?:the |a )?)?bsd style licen[cs]e
2 bsd-2 :: simplified bsd :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?simplified bsd licen[cs]e
2 bsd-3 :: bsd licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e
2 apache-2 :: apache licen :: (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?apache licen[cs]e (?:version |v ?)?2(?: 0)?
2 apache-2 :: apache software licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache software licen[cs]e (?:version |v ?)?2(?: 0)?
2 apache-1-1 :: apache software licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache software licen[cs]e (?:version |v ?)?1 1
2 gpl-3 :: gpl :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?
2 gpl-2 :: gpl :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?
2 gpl-3 :: general public licen :: (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e (?:version |v ?)?3(?: 0)?
2 gpl-2 :: general public licen :: (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e (?:version |v ?)?2(?: 0)?
2 lgpl-3 :: lesser general public licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
2 lgpl-2-1 :: lesser general public licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1
2 agpl-3 :: affero general public licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
2 mpl-2 :: mozilla public licen :: (?:licensed|released|distributed|available|subject to|governed by)(?: under)? (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
2 epl-2 :: eclipse public licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
2 epl-1 :: eclipse public licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
2 cddl-1 :: common development and distribution :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?common development and distribution licen[cs]e
2 eupl-1-2 :: european union public licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?european union public licen[cs]e(?: (?:version |v ?)?1 2)?
2 artistic-2 :: artistic licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?artistic licen[cs]e (?:version |v ?)?2(?: 0)?
2 perl :: same terms as perl :: redistribute it and or modify it under the same terms as perl itself
2 ruby :: same terms as ruby :: (?:licensed|released|distributed|available) under the same terms as ruby
2 zlib :: zlib licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?zlib licen[cs]e
2 boost-1 :: boost software licen :: (?:licensed|released|available|used|provided) under (?:the )?(?:terms of (?:the )?)?boost software licen[cs]e(?: version 1 0)?
2 unlicense :: unlicen :: (?:licensed|released|distributed|available|dedicated) under (?:the )?(?:terms of (?:the )?)?unlicen[cs]e
2 psf-2 :: python software foundation :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?python software foundation licen[cs]e
2 postgresql :: postgresql licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?postgresql licen[cs]e
2 vim :: vim licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?vim licen[cs]e
2 ms-pl :: microsoft public licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?microsoft public licen[cs]e
2 ms-rl :: microsoft reciprocal licen :: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?microsoft reciprocal licen[cs]e
2 cc-by :: cc by :: (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?cc by(?! (?:nc|sa|nd)\b)(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc-by-sa :: cc by sa :: (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?cc by sa(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc-by-nd :: cc by nd :: (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?cc by nd(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc-by-nc :: cc by nc :: (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?cc by nc(?! (?:sa|nd)\b)(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc-by-nc-sa :: cc by nc sa :: (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?cc by nc sa(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc-by-nc-nd :: cc by nc nd :: (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?cc by nc nd(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc-by :: creative commons attribution :: (?:licensed|released|distributed|available|published) under (?:a |the )?creative commons attribution(?! (?:non ?commercial|share ?alike|no ?deriv[a-z]*))(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc-by-sa :: creative commons attribution :: (?:licensed|released|distributed|available|published) under (?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc-by-nc :: creative commons attribution :: (?:licensed|released|distributed|available|published) under (?:a |the )?creative commons attribution non ?commercial(?! (?:share ?alike|no ?deriv[a-z]*))(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
2 cc0-1 :: cc0 :: (?:licensed|released|distributed|available|dedicated|published) (?:under|to|with) (?:the )?(?:terms of (?:the )?)?cc0(?: 1 0)?(?: universal)?
2 public-domain :: public domain :: (?:placed|released|dedicated|put|donated) (?:in|into|to) the public domain
3 mit :: mit licen :: mit licen[cs]e
3 mit :: expat licen :: expat licen[cs]e
3 x11 :: x11 licen :: x11 licen[cs]e
3 isc :: isc licen :: isc licen[cs]e
3 bsd-2 :: simplified bsd licen :: simplified bsd licen[cs]e
3 bsd-2 :: bsd 2 clause :: bsd 2 clause(?: licen[cs]e)?
3 bsd-2 :: 2 clause bsd :: 2 clause bsd(?: licen[cs]e)?
3 bsd-3 :: bsd 3 clause :: bsd 3 clause(?: licen[cs]e)?
3 bsd-3 :: 3 clause bsd :: 3 clause bsd(?: licen[cs]e)?
3 bsd-3 :: new bsd licen :: new bsd licen[cs]e
3 bsd-3 :: modified bsd licen :: modified bsd licen[cs]e
3 bsd-4 :: original bsd licen :: original bsd licen[cs]e
3 apache-2 :: apache licen :: apache licen[cs]e (?:version |v ?)?2(?: 0)?
3 apache-2 :: apache software licen :: apache software licen[cs]e (?:version |v ?)?2(?: 0)?
3 apache-1-1 :: apache software licen :: apache software licen[cs]e (?:version |v ?)?1 1
3 apache-2 :: apache 2 :: apache 2 0(?: licen[cs]e)?
3 gpl-3 :: gplv3 :: (?:gnu )?gplv3(?: 0)?
3 gpl-2 :: gplv2 :: (?:gnu )?gplv2(?: 0)?
3 gpl-3 :: gpl :: (?:gnu )?gpl (?:version |v ?)?3(?: 0)?
3 gpl-2 :: gpl :: (?:gnu )?gpl (?:version |v ?)?2(?: 0)?
3 gpl-3 :: general public licen :: (?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?
3 gpl-2 :: general public licen :: (?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?
3 lgpl-3 :: lgpl :: (?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?
3 lgpl-2-1 :: lgpl :: (?:gnu )?lgpl ?(?:version |v ?)?2 1
3 lgpl-3 :: lesser general public licen :: (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
3 lgpl-2-1 :: lesser general public licen :: (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1
3 agpl-3 :: agpl :: (?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?
3 agpl-3 :: affero general public licen :: (?:gnu )?affero general public licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?
3 gfdl-1-3 :: gnu free documentation licen :: gnu free documentation licen[cs]e(?: (?:version |v ?)?1 3)?
3 mpl-2 :: mozilla public licen :: mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
3 mpl-1-1 :: mozilla public licen :: mozilla public licen[cs]e (?:version |v ?)?1 1
3 epl-2 :: eclipse public licen :: eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
3 epl-1 :: eclipse public licen :: eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
3 cpl-1 :: common public licen :: common public licen[cs]e (?:version |v ?)?1(?: 0)?
3 cddl-1 :: common development and distribution :: common development and distribution licen[cs]e(?: (?:version |v ?)?1(?: [01])?)?
3 eupl-1-2 :: european union public licen :: european union public licen[cs]e(?: (?:version |v ?)?1 2)?
3 osl-3 :: open software licen :: open software licen[cs]e (?:version |v ?)?3(?: 0)?
3 afl-3 :: academic free licen :: academic free licen[cs]e (?:version |v ?)?3(?: 0)?
3 artistic-2 :: artistic licen :: artistic licen[cs]e (?:version |v ?)?2(?: 0)?
3 artistic-1 :: artistic licen :: artistic licen[cs]e (?:version |v ?)?1(?: 0)?
3 zlib :: zlib licen :: zlib licen[cs]e
3 zlib :: zlib libpng licen :: zlib libpng licen[cs]e
3 libpng :: libpng licen :: libpng licen[cs]e
3 boost-1 :: boost software licen :: boost software licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
3 unlicense :: unlicen :: unlicen[cs]e
3 wtfpl :: do what the f :: do what the f[a-z]* you want to public licen[cs]e
3 wtfpl :: wtfpl :: wtfpl(?: (?:version |v ?)?2)?
3 beerware :: beerware licen :: beerware licen[cs]e
3 psf-2 :: python software foundation licen :: python software foundation licen[cs]e(?: (?:version |v ?)?2)?
3 php-3 :: php licen :: php licen[cs]e(?: (?:version |v ?)?3(?: 0[01])?)?
3 openssl :: openssl licen :: openssl licen[cs]e
3 postgresql :: postgresql licen :: postgresql licen[cs]e
3 vim :: vim licen :: vim licen[cs]e
3 ncsa :: illinois ncsa open source licen :: (?:university of )?illinois ncsa open source licen[cs]e
3 ms-pl :: microsoft public licen :: microsoft public licen[cs]e
3 ms-rl :: microsoft reciprocal licen :: microsoft reciprocal licen[cs]e
3 qpl-1 :: q public licen :: q public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
3 sleepycat :: sleepycat licen :: sleepycat licen[cs]e
3 ofl-1-1 :: open font licen :: (?:sil )?open font licen[cs]e(?: (?:version |v ?)?1 1)?
3 odbl-1 :: open database licen :: (?:open data commons )?open database licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
3 odc-by-1 :: open data commons attribution :: open data commons attribution licen[cs]e
3 ogl-uk-3 :: open government licen :: open government licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?
3 lppl-1-3 :: latex project public licen :: latex project public licen[cs]e(?: (?:version |v ?)?1 3[a-c]?)?
3 cecill-2 :: cecill :: cecill(?: (?:b|c))?(?: licen[cs]e)?(?: (?:version |v ?)?2(?: [01])?)?
3 mulan-2 :: mulan permissive :: mulan permissive software licen[cs]e(?: (?:version |v ?)?2)?
3 sspl-1 :: server side public licen :: server side public licen[cs]e
3 busl-1-1 :: business source licen :: business source licen[cs]e(?: (?:version |v ?)?1 1)?
3 elastic-2 :: elastic licen :: elastic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
3 openrail :: openrail :: (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
3 cc0-1 :: cc0 :: cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?
3 cc-by :: cc by :: cc by(?! (?:nc|sa|nd)\b)(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-sa :: cc by sa :: cc by sa(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-nd :: cc by nd :: cc by nd(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-nc :: cc by nc :: cc by nc(?! (?:sa|nd)\b)(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-nc-sa :: cc by nc sa :: cc by nc sa(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-nc-nd :: cc by nc nd :: cc by nc nd(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by :: creative commons attribution :: creative commons attribution(?! (?:non ?commercial|share ?alike|no ?deriv[a-z]*))(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-sa :: creative commons attribution :: creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-nd :: creative commons attribution :: creative commons attribution no ?deriv[a-z]*(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-nc :: creative commons attribution :: creative commons attribution non ?commercial(?! (?:share ?alike|no ?deriv[a-z]*))(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-nc-sa :: creative commons attribution :: creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 cc-by-nc-nd :: creative commons attribution :: creative commons attribution non ?commercial no ?deriv[a-z]*(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
3 public-domain :: public domain :: (?:is |are )?(?:in|into|to) the public domain
3 all-rights-reserved :: all rights reserved :: all rights reserved
3 proprietary :: proprietary licen :: proprietary licen[cs]e
3 commercial :: commercial licen :: commercial licen[cs]e (?:agreement|terms|is required|required)
3 non-commercial :: for non commercial use :: for non commercial use only
3 research-only :: for research purposes only :: for research purposes only
3 internal-use :: internal use only :: (?:for )?internal use only
"""
CONFIDENCE = {1: 0.99, 2: 0.95, 3: 0.6}


def rules() -> list[tuple[int, int, str, float, str, str]]:
    """(order, tier, label, confidence, keyword, regex); earlier rules win ties."""
    out = []
    for n, line in enumerate(RULES.strip().splitlines()):
        name, keyword, regex = line.split(" :: ")
        tier, label = name.split()
        out.append((n, int(tier), label, CONFIDENCE[int(tier)], keyword, regex))
    return out


NO_WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters whose lower case holds ASCII letters.
_ODD = "[\u212a\u0130]"


def _words(text: Column) -> Column:
    """Words, A-Z lowered, each between single blanks; one blank if there are none.

    Letters beyond ASCII are lowered too, which no rule or phrase sees (and which is
    quicker), but for the two that would become ASCII.
    """
    words = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), NO_WORD, " ")
    return F.when(text.rlike(_ODD), F.translate(words, _UPPER, _UPPER.lower())).otherwise(F.lower(words))


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x evaluated once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


FOUND = "array<struct<label:string,tier:int,rule:int,confidence:double,start:bigint,end:bigint>>"
#: Elements of a part of a running total.
PART = 128


def _before(x: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Of each element of an array of longs what ``op`` makes of those before it.

    In two levels, so that growing arrays stay short: time follows the length.
    """
    start = F.lit(zero).cast("long")

    def along(part: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, first, step, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        bases = along(F.transform(parts, lambda p: F.aggregate(p, start, op)))
        return F.flatten(F.zip_with(parts, bases, lambda p, b: F.transform(along(p), lambda v: op(v, b))))

    def cut(whole: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / PART).cast("int")), lambda i: F.slice(whole, i * PART + 1, F.lit(PART)))
        return F.when(F.size(whole) > 0, _bound(parts, joined)).otherwise(F.array().cast("array<bigint>"))

    return _bound(x, cut)


_SUM = lambda a, b: a + b
_MOST = lambda a, b: F.greatest(a, b)


def _spans(w: Column, r: Column) -> Column:
    """All matches of rule r, as structs; ``start`` and ``end`` count characters of the words."""

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: F.length(p).cast("long"))
        begins = _before(lengths, _SUM, 0)

        def one(p: Column, b: Column) -> Column:
            end = b + F.length(p)
            start = end - F.length(F.call_function("regexp_extract", p, r["hit"], F.lit(1)))
            return F.struct(start.alias("start"), (-end).alias("back"), r["tier"].alias("tier"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence"), end.alias("end"))

        return F.zip_with(pairs, begins, one)

    return _bound(F.regexp_extract_all(w, r["parts"], F.lit(0)), placed)


def _resolve(spans: Column) -> Column:
    """Drop what lies within a detection of the same or a better tier.

    In the order of start, longest first, a detection is contained exactly if an
    earlier one ends at or behind its end, so the running ends of each tier decide.
    """

    none = F.lit(-1).cast("long")

    def reached(rows: Column, found: Column, t: int) -> Column:
        ends = _before(F.transform(found, lambda s: F.when(s["tier"] == t, s["end"]).otherwise(none)), _MOST, -1)
        reach = lambda x, e: F.when(F.lit(t) <= x["span"]["tier"], F.greatest(x["reach"], e)).otherwise(x["reach"])
        return F.zip_with(rows, ends, lambda x, e: F.struct(x["span"].alias("span"), reach(x, e).alias("reach")))

    def kept(found: Column) -> Column:
        rows = F.transform(found, lambda s: F.struct(s.alias("span"), none.alias("reach")))
        for t in (1, 2, 3):
            rows = reached(rows, found, t)
        return F.transform(F.filter(rows, lambda x: x["reach"] < x["span"]["end"]), lambda x: x["span"])

    return _bound(F.array_sort(spans), kept)


def _any_of(words: list[str]) -> str:
    """A regex of these words that looks at each common beginning once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def regex(node: dict) -> str:
        if "" in node:  # a shorter word is enough
            return ""
        parts = [c + regex(child) for c, child in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return regex(tree)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base, detections.

    ``detections`` are the surviving matches: label, tier, rule, confidence, start
    and end in the characters of the document's words.  No shuffle, no Python.
    """
    require(docs, ["doc_id", "text"])
    table = rules()
    by: dict[str, list[tuple[int, str]]] = {}
    for o, *_, keyword, regex in table:
        by.setdefault(keyword, []).append((o, regex))
    phrase = " (?:" + "|".join(PHRASES) + ")(?= )"
    gate = " " + _any_of(sorted(by))
    rows = docs.select(F.col("doc_id").cast("long"), _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    rows = rows.select("doc_id", (_spaces(F.col("w")) - 1).alias("n_words"), F.when(F.col("w").rlike(gate), F.col("w")).alias("w"))

    w = F.col("w")
    tried = [F.when(F.contains(w, F.lit(f" {k}")), F.array_compact(F.array(*[F.when(w.rlike(f" {x}(?= )"), F.lit(o)) for o, x in own]))) for k, own in by.items()]
    fired = F.flatten(F.array_compact(F.array(*tried)))
    # what is known of each rule: a constant, folded once
    listed = [{"rule": o, "tier": t, "label": la, "confidence": c, "parts": rf"(?s)\G.*?( {x})(?= )", "hit": rf"(?s)( {x})\z"} for o, t, la, c, _, x in table]
    known = F.from_json(F.lit(json.dumps(listed)), "array<struct<rule:int,tier:int,label:string,confidence:double,parts:string,hit:string>>")
    rows = rows.withColumn("fired", F.when(w.isNotNull(), fired))
    rows = rows.withColumn("detections", F.when(F.size("fired") > 0, _resolve(F.flatten(F.transform("fired", lambda i: _bound(F.get(known, i), lambda r: _spans(w, r)))))))
    rows = rows.withColumn("n_base", F.coalesce(F.regexp_count("w", F.lit(phrase)).cast("long"), F.lit(0).cast("long")))
    found = F.col("n_base") > 0
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(w, F.lit(f" {p} ")), F.lit(v)) for p, v in PHRASES.items()]))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        F.when(found, _spaces(F.regexp_extract("w", rf"(?s)\A(.*?){phrase}", 1))).alias("first_word"),
        F.when(found, _spaces(F.regexp_extract("w", rf"(?s)\A(.*){phrase}", 1))).alias("last_word"),
        F.when(found, base).otherwise(F.array().cast("array<string>")).alias("base"),
        F.coalesce(F.transform("detections", lambda d: F.struct(d["label"].alias("label"), d["tier"].alias("tier"), d["rule"].alias("rule"), d["confidence"].alias("confidence"), d["start"].alias("start"), d["end"].alias("end"))), F.array().cast(FOUND)).alias("detections"),
    )


#: Confidence of a plain phrase.
PLAIN = 0.9


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base"), F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, F.lit(PLAIN)).otherwise(F.lit(0.0))).alias("score"),
    )


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op9_licenses`` SQL can express: the plain phrases."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


PHRASES_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), p AS (
  SELECT unnest([['under', 'the', 'mit', 'license'], ['apache', 'license', 'version', '2'], ['cc', 'by', 'nc']]) AS words, unnest(['mit', 'apache-2', 'cc-by-nc']) AS label
), hits AS (
  SELECT doc_id, label, i - 1 AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x, p WHERE w[i:i + len(words) - 1] = words
), g AS (
  SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

QUERIES = {"op9_licenses": op9_licenses, "license_phrases": license_phrases}
ORACLES = {"license_phrases": PHRASES_SQL}

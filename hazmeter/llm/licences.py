"""Licence notices and headers by family, a paragraph each, in the wording of the licences; and paragraphs that grant none."""

from __future__ import annotations

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_GNU_GRANT = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_HOPE = "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
_GNU_COPY = "You should have received a copy of the GNU {}General Public License along with this {}. If not, see https://www.gnu.org/licenses/."

TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "This project is licensed under the MIT license.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _AS_IS,
    ),
    "isc": (
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Released under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.", "Licensed under the two clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Distributed under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GPL, version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU GPL v3.", "Distributed under the GPL-3.0 license.",
        _GNU_GRANT.format("This program", "", 3), _GNU_HOPE.format("This program", ""), _GNU_COPY.format("", "program"),
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Distributed under the LGPL.", "Released under the LGPL v3.",
        _GNU_GRANT.format("This library", "Lesser ", "2.1"), _GNU_HOPE.format("This library", "Lesser "), _GNU_COPY.format("Lesser ", "library"),
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL v3.",
        _GNU_GRANT.format("This program", "Affero ", 3), _GNU_HOPE.format("This program", "Affero "), _GNU_COPY.format("Affero ", "program"),
    ),
    "mpl": (
        "SPDX-License-Identifier: MPL-2.0", "Licensed under the MPL 2.0 license.", "Released under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "epl": (
        "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License 2.0.", "Released under the EPL 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "zlib": (
        "Released under the zlib license.", "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ),
    "unlicense": (
        "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-NonCommercial 4.0 International license.",
    ),
    "cc0": (
        "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal.", "Released under Creative Commons Zero, CC0.",
    ),
    "wtfpl": ("SPDX-License-Identifier: WTFPL", "Licensed under the WTFPL, version 2.", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    "proprietary": (
        "Copyright. All rights reserved.", "All rights reserved.", "No license is granted; all rights reserved.", "This software is proprietary and confidential. Unauthorized copying is prohibited. All rights reserved.",
        "This software contains proprietary information and trade secrets of the company and may not be disclosed, copied or used except under a written license agreement. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
#: Paragraphs that speak of licences, law or software and grant nothing.
FOREIGN = (
    "You need a driving license to rent a car.", "The license expired last year and had to be renewed.", "Copyright law protects authors for many years.", "The restaurant lost its liquor license in the spring.", "Please read the license before you install the program.",
    "A license fee is due each month.", "She is a licensed nurse in two states.", "The court ruled on copyright in the case of the song.", "Apache helicopters flew over the river.", "The fishing licence costs ten pounds for any person over twelve.", "He asked for permission to leave the room and it was granted.",
    "Licensed drivers only, please.", "Mozilla hosts a conference on the open web.", "Creative people met in the commons.", "The licence plate was stolen.", "There is no warranty on the old car.", "Reserved seats are on the left.", "The general public is welcome.", "The public domain holds many old books.",
    "You may obtain a copy of the form at the office.", "The software was distributed to all schools free of charge.", "Use of this room is governed by the house rules.", "The author disclaims any knowledge of the event.", "Redistribution of wealth is a subject of debate.", "Eclipse watchers gathered in the field to see the sun.",
    "The boost in sales was unexpected.", "The terms of the contract are subject to change.", "All guests must retain the ticket and this notice until the end.", "The product is provided with a list of conditions and a receipt.", "In no event shall the door be left open.", "The company was held liable for damages arising from the accident.",
    "Patents and copyrights differ in scope and term.", "Version 2.0 of the program is available at the shop.", "The foundation published a free book.", "It is hoped that the library will be useful to students.", "Unless agreed in writing, the deposit is not returned.", "This file was copied from the old disk.", "Source code must compile without errors.",
    "Changing the name of the document is allowed.", "The zero was named in India.", "Commercial use of the hall needs a permit.", "The original software was written in two weeks.", "Anyone is free to join the walk.", "The two clause contract was signed in March.", "MIT and its students won the prize.", "The BSD socket was invented long ago.",
)
#: Words so common that no run of them alone speaks of a licence.
COMMON = frozenset("a about above after all along also an and any anyone are as at available be been before being but by can claim code copies copy data did do does each either end even event every file find following for form found free from had has have he her his holders how however if in including into is it its law left list long made many materials may means more most must name names new no nor not of off old on one only open or other our out over page part people person persons place prior product products program public purpose read related right rights rules see she should site so some source such terms text than that the their them then there they third this those to under until up upon use used useful user version via was way we were what when where whether which who will with without work world would written year you your".split())

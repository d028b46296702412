"""Texts by which the license scan knows licenses: whole texts (the files of the folder licenses), passages of them, and usual wordings of notices."""

from __future__ import annotations

from pathlib import Path

# Passages of the licenses' own texts.  A body is known by its opening, or by each of its paragraphs where it is short.
BODIES = {
    "GPL-3.0/notice": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    "GPL-2.0/notice": 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.',
    "GPL/warranty": 'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "AGPL-3.0/notice": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    "LGPL-2.1/notice": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
    "LGPL-3.0/notice": 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0/warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0/text": 'TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "GPL-3.0/text": 'The GNU General Public License is a free, copyleft license for software and other kinds of works.',
    "GPL-2.0/text": 'The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.',
    "LGPL-3.0/text": 'This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.',
    "LGPL-2.1/text": 'This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.',
    "AGPL-3.0/text": 'The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.',
    "MPL-2.0/text": '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    "BSD/binary": 'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD/source": 'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.',
    "BSD/disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "ISC/disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "MIT/rights": 'to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "MIT/condition": 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT/disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "CC-4.0/text": 'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons',
    "All-rights-reserved": 'All rights reserved.',
    "All-rights-reserved/permission": 'No part of this publication may be reproduced, distributed, or transmitted in any form or by any means',
}

# How notices begin, and the names of each license in them.  No name is the beginning of another name of its license.
LEADS = ("licensed under", "released under", "distributed under", "available under", "published under", "provided under", "covered by", "governed by", "subject to", "under the terms of", "under the terms and conditions of")
OF_ONE_WORD = LEADS[:4]  # names like MIT and BSD mean other things after the others
NAMES = {
    "MIT": ("the MIT License", "MIT", "an MIT license"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0", "the Apache 2.0 License", "the Apache Software License"),
    "GPL": ("the GNU General Public License", "the GNU GPL", "GNU GPL", "the GPL", "GPL", "GPLv2", "GPLv3", "the GPLv2", "the GPLv3"),
    "AGPL": ("the GNU Affero General Public License", "the GNU AGPL", "the AGPL", "AGPL", "AGPLv3", "the AGPLv3"),
    "LGPL": ("the GNU Lesser General Public License", "the GNU LGPL", "the LGPL", "LGPL", "LGPLv3", "the LGPLv3"),
    "BSD": ("the BSD License", "BSD", "a BSD license", "a BSD-style license", "the 3-Clause BSD License", "the 2-Clause BSD License", "the BSD 3-Clause", "the BSD 2-Clause", "the New BSD License", "the Modified BSD License", "the Simplified BSD License"),
    "MPL-2.0": ("the Mozilla Public License", "Mozilla Public License", "MPL 2.0", "the MPL 2.0"),
    "ISC": ("the ISC License", "ISC"),
}
CC = {"CC-BY-4.0": ("BY", "Attribution"), "CC-BY-SA-4.0": ("BY-SA", "Attribution-ShareAlike"), "CC-BY-NC-4.0": ("BY-NC", "Attribution-NonCommercial"), "CC-BY-ND-4.0": ("BY-ND", "Attribution-NoDerivatives"),
      "CC-BY-NC-SA-4.0": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), "CC-BY-NC-ND-4.0": ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")}
SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", *CC)
PLACES = {"MIT": "opensource.org/licenses/MIT", "Apache-2.0": "apache.org/licenses/LICENSE-2.0", "GPL": "gnu.org/licenses/gpl", "AGPL": "gnu.org/licenses/agpl", "LGPL": "gnu.org/licenses/lgpl", "BSD": "opensource.org/licenses/BSD", "MPL-2.0": "mozilla.org/MPL/2.0", "ISC": "opensource.org/licenses/ISC"}


def wordings() -> dict[str, str]:
    """Usual wordings by template_id, which is the license and the wording."""
    found = [(k, f"{lead} {name}") for k, names in NAMES.items() for name in names for lead in (LEADS if " " in name else OF_ONE_WORD)]
    found += [(k, f"SPDX-License-Identifier: {k}") for k in SPDX] + list(PLACES.items())
    for k, (short, long) in CC.items():
        # The name with its version states the license, whatever stands before it.
        found += [(k, f"CC {short} 4.0"), (k, f"Creative Commons {long} 4.0"), (k, f"creativecommons.org/licenses/{short.lower()}/4.0")]
    return {f"{k}/{text}": text for k, text in found}


def whole() -> dict[str, str]:
    """The whole license texts by template_id, <license>/whole."""
    return {f"{f.stem}/whole": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}

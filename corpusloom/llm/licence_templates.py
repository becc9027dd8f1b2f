"""What the licence scan compares with: whole licence texts, source headers, and notices made by rule from titles."""

from __future__ import annotations

from pathlib import Path

FOLDER = Path(__file__).resolve().parent / "licences"

#: How works name each licence; the key is its SPDX identifier.
TITLES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-style three clause license"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal public domain dedication"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"),
    "Unlicense": ("Unlicense",),
}

#: The headers that licences ask source files to carry.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
        the License.""",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free
    Software Foundation, either {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it
    will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
    See the {1} for more details."""
_GNU_SHORT = """This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free
    Software Foundation, either {2} of the License, or (at your option) any later version."""
FRAMES = (
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
    "This project is licensed under the {} - see the LICENSE file for details.", "{}",
)


def templates() -> list[tuple[str, str]]:
    """``(SPDX identifier, text)`` of every template, by identifier."""
    out = []
    for name, titles in TITLES.items():
        out += [(name, f"SPDX-License-Identifier: {name}")]
        out += [(name, frame.format(titles[0])) for frame in FRAMES]
        out += [(name, frame.format(title)) for title in titles[1:] for frame in FRAMES[::4]]
        if "GNU" in titles[0]:
            licence, _, version = titles[0].partition(", ")
            out += [(name, header.format("library" if name[0] == "L" else "program", licence, version)) for header in (_GNU, _GNU_SHORT)]
        if name in HEADERS:
            out.append((name, HEADERS[name]))
        if (FOLDER / f"{name}.txt").exists():
            out.append((name, (FOLDER / f"{name}.txt").read_text()))
    return out

"""The license library: whole texts, standard headers, notices by name, and SPDX identifiers.

Whole texts are the files of `licenses`, as the licensors publish them, without
copyright lines.  Names of templates are `id`, `id/header`, `id/notice-i`, `id/spdx`
and `id/id`.
"""

from __future__ import annotations

import re
from pathlib import Path

HERE = Path(__file__).resolve().parent / "licenses"

_GPL = """{it} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{version}.
{it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""


def _gnu(kind: str, version: str, it: str) -> str:
    return _GPL.format(kind=kind, it=it, colon=":" if version == "3" else ";", version=f", either version {version} of the License, or (at your option) any later version")


HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
} | {
    f"{name}/{i}": _gnu(kind, version, it)
    for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))
    for i, it in (("program", "This program"), ("library", "This library"))
}

_CC = [(f"CC-{k}-{v}", [f"CC {k} {v}", f"Creative Commons {long} {v}", f"Creative Commons {long} {v} International License"]) for k, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]


def _gnu_names(short: str, long: str, version: str) -> list[str]:
    major = [version, version[:-2]] if version.endswith(".0") else [version]
    return [n for v in major for n in (f"GNU {long} version {v}", f"GNU {long} v{v}", f"{short}v{v}", f"GNU {short} v{v}", f"GNU {short} version {v}")]


#: Names by which notices call a license; `under` and its variants are put before those that are plain words.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT license terms"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "BSD": ["BSD License", "BSD-style license"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "Mozilla Public License 1.1"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0"],
    "BSL-1.0": ["Boost Software License", "Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "CC0"],
} | {
    f"{short}-{v}": _gnu_names(short, long, v)
    for short, long, versions in (("GPL", "General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)))
    for v in versions
}
BEFORE = ("under the", "under", "under the terms of the", "subject to the")


def _words(text: str) -> tuple[str, ...]:
    return tuple(re.sub(r"[^a-z0-9]+", " ", text.lower()).split())


def library() -> dict[str, str]:
    """name -> text, no two with the same words; the first name given is kept."""
    out: dict[str, str] = {}
    seen: set = set()

    def add(name: str, text: str) -> None:
        key = _words(text)
        if key and key not in seen:
            seen.add(key)
            out[name] = text

    for path in sorted(HERE.glob("*.txt")):
        add(path.stem, path.read_text(encoding="utf-8"))
    for name, text in HEADERS.items():
        add(f"{name}/header", text)
    for name, names in NAMES.items():
        for i, text in enumerate(f"{before} {n}" for n in names for before in BEFORE):
            add(f"{name}/notice-{i}", text)
    for name, names in _CC:
        for i, text in enumerate(names):
            add(f"{name}/notice-{i}", text)
    add("all-rights-reserved", "All rights reserved.")
    for one in (HERE / "spdx_ids").read_text(encoding="utf-8").split():
        add(f"{one}/spdx", f"SPDX-License-Identifier: {one}")
        if re.search(r"-\d+\.\d+", one):
            add(f"{one}/id", one)
    return out

"""Digests of long licence texts and further one-line notices (fixed values).

A digest is that of the canonical text without its head (see ``license_scan``);
texts with an appendix on how to apply them are known with and without it.
"""

from __future__ import annotations

DIGESTS = {
    "3b007760ca09b0678effc9d3d74597dc31e92b682a83d10e09b6dfd8343287e0": "Apache-2.0",
    "4b5828edb0ed9320212fb3c50151091c03d2da294e2a283e5d33cda1e2d9c2fd": "Apache-2.0",
    "ecae8a5a0c9832e141179311b86748054a8755f17b0c2ebec9cea58f01c3abf6": "Apache-2.0",
    "09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "2f75fa79b178d495a9ab6b69b82e5502c3cb2012aff01a5b63768646ace39d89": "GFDL-1.2",
    "2b0aab60b751972557008e87c702427490cdc2d749c1d4fd0b7fca5016b92e69": "GFDL-1.3",
    "004d51305feee6b52152c2f281ce28deaeb53eb4a4d007ee76cd7a921214d66a": "GPL-1.0",
    "9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c": "GPL-1.0",
    "ca8a13e258985f008e9e869c46b2f9ce910ff6e64682660c0130a3a2597b9056": "GPL-1.0",
    "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f": "GPL-2.0",
    "639c69262acf6777ee0c163867caf39bdb5ec90b59bad9412c9e6101fb65e404": "GPL-2.0",
    "b519669ce969d79c162f16dca67a0abab53b46986efb528afe3e105936cc0050": "GPL-2.0",
    "7649ebbf3b070f38d710d6c6b656cbe1d02e00991423dedb73cb040e73d42572": "GPL-3.0",
    "888dd3b6e21b31412e3e47000b49d18dbd8f52fb42ccb5fc3108c8ca3c150b16": "GPL-3.0",
    "bf9e206799496404ec781ceaf777966308e875445239b2a25248b6a0f817844d": "GPL-3.0",
    "1bcddbd821db9aff439d7cd0cc29582bde4192194dead3bbf1218f38ca99554f": "LGPL-2.0",
    "9c23d4ec08c96de18510022fc734a8ee0a97727299d09046fc5ce263d269352e": "LGPL-2.0",
    "f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e": "LGPL-2.0",
    "02d1c6765d5d7d83c080934e4f4d4e8a534db157a3addff8d581f70e285a297a": "LGPL-2.1",
    "1b0f2373f80527d4e0de3c4558c0b3804f46c844770e82398a9876c782f360f9": "LGPL-2.1",
    "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4": "LGPL-2.1",
    "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765": "LGPL-3.0",
    "0660d1922f9d3acf19bf9040a5c9636739265bae8625a5643a955e9e5283dec1": "MPL-1.1",
    "61525901247b1a7c093fc10f73de8260d1d1a1a8b3bc78f417119ee4fcfb0979": "MPL-2.0",
}

#: By licence, wordings beside those of ``license_scan.NOTICES``.
MORE_NOTICES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "Licensed under the Apache License 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "This project is licensed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC-BY-NC-4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "GPL-3.0": (
        "This program is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "Licensed under the GNU GPL, version 3.",
        "Licensed under the GPLv3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Distributed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0.",
        "Licensed under the GPLv2.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "Released under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "Unlicense": (
        "Released under the Unlicense.",
        "Licensed under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Zlib": (
        "SPDX-License-Identifier: Zlib",
    ),
    "0BSD": (
        "SPDX-License-Identifier: 0BSD",
    ),
}

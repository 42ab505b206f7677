"""License notices as people write them, and the labels that a reader would give; written by hand, apart from the rules."""

from claimlake.llm import license_scan

NOTICES = [
    ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: ISC", "isc"), ("// SPDX-License-Identifier: 0BSD", "0bsd"), ("SPDX-License-Identifier: Unlicense", "unlicense"), ("# SPDX-License-Identifier: Zlib", "zlib"),
    ("SPDX-License-Identifier: BSL-1.0", "boost-1.0"), ("SPDX-License-Identifier: WTFPL", "wtfpl"), ("SPDX-License-Identifier: Python-2.0", "python-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0-only"), ("SPDX-License-Identifier: GPL-2.0+", "gpl-2.0-or-later"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "gpl-2.0-or-later"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1-only"), ("SPDX-License-Identifier: LGPL-2.1+", "lgpl-2.1-or-later"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl-3.0-or-later"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("<!-- SPDX-License-Identifier: MPL-2.0 -->", "mpl-2.0"), ("SPDX-License-Identifier: EPL-2.0", "epl-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: BSD-2-Clause", "bsd-2-clause"), ("SPDX-License-Identifier: BSD-2-Clause-Patent", "bsd-2-clause-patent"),
    ("SPDX-License-Identifier: CC0-1.0", "cc0-1.0"), ("SPDX-License-Identifier: CC-BY-4.0", "cc-by-4.0"), ("SPDX-License-Identifier: CC-BY-SA-3.0", "cc-by-sa-3.0"), ("SPDX-License-Identifier: OFL-1.1", "ofl-1.1"), ("SPDX-License-Identifier: Artistic-2.0", "artistic-2.0"),
    ("SPDX-License-Identifier: PostgreSQL", "postgresql"), ("SPDX-License-Identifier: MS-PL", "ms-pl"), ("SPDX-License-Identifier: MIT-0", "mit-0"), ("SPDX-License-Identifier: Ruby", "ruby"), ("SPDX-License-Identifier: curl", "curl"),
    ("SPDX-License-Identifier: EUPL-1.2", "eupl-1.2"), ("SPDX-License-Identifier: CDDL-1.1", "cddl-1.1"), ("SPDX-License-Identifier: NCSA", "ncsa"), ("SPDX-License-Identifier: UPL-1.0", "upl-1.0"), ("SPDX-License-Identifier: BUSL-1.1", "bsl-1.1"),
    ("SPDX-License-Identifier: SSPL-1.0", "sspl-1.0"), ("SPDX-License-Identifier: Elastic-2.0", "elastic-2.0"), ("SPDX-License-Identifier: BlueOak-1.0.0", "blueoak-1.0.0"), ("SPDX-License-Identifier: MulanPSL-2.0", "mulanpsl-2.0"), ("SPDX-License-Identifier: OSL-3.0", "osl-3.0"),
    ("SPDX-License-Identifier: X11", "x11"), ("SPDX-License-Identifier: W3C", "w3c"), ("SPDX-License-Identifier: ZPL-2.1", "zpl-2.1"), ("SPDX-License-Identifier: LPPL-1.3c", "lppl-1.3c"), ("SPDX-License-Identifier: GFDL-1.3-only", "gfdl-1.3-only"),
    ("SPDX-License-Identifier: ODbL-1.0", "odbl-1.0"), ("SPDX-License-Identifier: PSF-2.0", "python-2.0"), ("SPDX-License-Identifier: HPND", "hpnd"), ("SPDX-License-Identifier: Beerware", "beerware"), ("SPDX-License-Identifier: Vim", "vim"),
    ("license: MIT", "mit"), ('"license": "MIT"', "mit"), ("license = 'ISC'", "isc"), ('"license": "Apache-2.0",', "apache-2.0"), ("License: BSD-3-Clause", "bsd-3-clause"),
    ("license: GPL-3.0-only", "gpl-3.0-only"), ("license: GPL-3.0-or-later", "gpl-3.0-or-later"), ("license = \"0BSD\"", "0bsd"), ("License: Unlicense", "unlicense"), ("licence: MPL-2.0", "mpl-2.0"),
    ("License :: Zlib", "zlib"), ("<license>EPL-2.0</license>", "epl-2.0"), ("LICENSE=WTFPL", "wtfpl"), ("license: CC0-1.0", "cc0-1.0"), ("license: AGPL-3.0", "agpl-3.0"),
    ("license: LGPL-2.1", "lgpl-2.1"), ('license="BSL-1.0"', "boost-1.0"), ("license: Artistic-2.0", "artistic-2.0"), ("license: MIT-0", "mit-0"), ("license: PostgreSQL", "postgresql"),
    ("MIT Licensed", "mit"), ("MIT licenced", "mit"), ("This is BSD licensed.", "bsd"), ("Apache licensed code", "apache"), ("It is ISC licensed", "isc"),
    ("GNU GPL", "gpl"), ("under the GNU GPL", "gpl"), ("GNU LGPL", "lgpl"), ("the GNU AGPL", "agpl"), ("GNU Public License", "gpl"),
    ("GPL v2", "gpl-2.0"), ("GPLv3 is GPL v3", "gpl-3.0"), ("GPL version 2 or later", "gpl-2.0-or-later"), ("GPL 3 only", "gpl-3.0-only"), ("LGPL 2.1 or any later version", "lgpl-2.1-or-later"),
    ("GNU General Public License v2.0", "gpl,gpl-2.0"), ("GNU General Public License, version 3", "gpl,gpl-3.0"), ("GNU Lesser General Public License", "gpl,lgpl"), ("GNU Affero General Public License", "agpl,gpl"), ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"),
    ("BSD-style license", "bsd"), ("a BSD style licence", "bsd"), ("New BSD License", "bsd-3-clause"), ("the Modified BSD license", "bsd-3-clause"), ("Revised BSD License", "bsd-3-clause"),
    ("Simplified BSD License", "bsd-2-clause"), ("FreeBSD License", "bsd-2-clause"), ("Original BSD License", "bsd-4-clause"), ("3-clause BSD license", "bsd-3-clause"), ("BSD 2-Clause License", "bsd-2-clause"),
    ("BSD Zero Clause License", "0bsd"), ("The Expat License", "mit"), ("MIT/X11 License", "mit"), ("an MIT-style license", "mit"), ("MIT No Attribution", "mit-0"),
    ("Apache Software License", "apache"), ("Apache License 2.0", "apache,apache-2.0"), ("Apache License, Version 1.1", "apache,apache-1.1"), ("Apache-2.0", "apache-2.0"), ("the Apache License", "apache"),
    ("Mozilla Public License", "mpl"), ("Mozilla Public License Version 2.0", "mpl-2.0"), ("MPL 1.1", "mpl-1.1"), ("Eclipse Public License", "epl"), ("Eclipse Public License v2.0", "epl-2.0"),
    ("Common Development and Distribution License", "cddl"), ("CDDL: Common Development and Distribution License 1.0", "cddl-1.0"), ("European Union Public Licence", "eupl"), ("European Union Public Licence v1.2", "eupl-1.2"), ("Artistic License", "artistic"),
    ("Academic Free License", "afl"), ("Open Software License 3.0", "osl-3.0"), ("GNU Free Documentation License", "gfdl"), ("Free Documentation License 1.3 or later", "gfdl-1.3-or-later"), ("SIL Open Font License", "ofl-1.1"),
    ("Open Font License", "ofl-1.1"), ("released under the Unlicense", "unlicense"), ("Do What The Fuck You Want To Public License", "wtfpl"), ("zlib/libpng License", "zlib"), ("the zlib license", "zlib"),
    ("PSF License", "python-2.0"), ("Python Software Foundation License", "python-2.0"), ("Boost License", "boost-1.0"), ("Boost Software License 1.0", "boost-1.0"), ("Microsoft Public License", "ms-pl"),
    ("Microsoft Reciprocal License", "ms-rl"), ("Open Database License", "odbl-1.0"), ("Universal Permissive License", "upl-1.0"), ("Mulan PSL v2", "mulanpsl-2.0"), ("Educational Community License", "ecl-2.0"),
    ("Common Public License", "cpl-1.0"), ("IBM Public License", "ipl-1.0"), ("Netscape Public License", "npl"), ("Sun Public License", "spl-1.0"), ("Zope Public License", "zpl"),
    ("LaTeX Project Public License", "lppl"), ("Apple Public Source License", "apsl"), ("Sleepycat License", "sleepycat"), ("curl license", "curl"), ("ImageMagick License", "imagemagick"),
    ("CC BY-SA 4.0", "cc-by-sa-4.0"), ("CC-BY-NC-ND 3.0", "cc-by-nc-nd-3.0"), ("Creative Commons Attribution 4.0 International", "cc-by-4.0"), ("Creative Commons Zero", "cc0-1.0"), ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "cc-by-sa-3.0"),
    ("All rights reserved.", "proprietary"), ("PROPRIETARY AND CONFIDENTIAL", "proprietary"), ("End User License Agreement", "proprietary"), ("placed in the public domain", "public-domain"), ("dedicated to the public domain", "public-domain"),
    ("OpenSSL License", "openssl"), ("Business Source License", "bsl-1.1"), ("Server Side Public License", "sspl-1.0"), ("Elastic License", "elastic-2.0"), ("Commons Clause", "commons-clause"),
]
#: Sentences that mention words of rules and no license.
PLAIN = [
    "The licensee shall permit the visit.", "a license to kill", "She has a driving licence.", "limits and permits of the MIT campus", "python 2 0 was a release", "vim and ruby are tools", "the json file of the parser",
    "an apache helicopter", "the clauses of the public", "C++ and 3+ years of work", "the license plate 2.0", "isc and zlib as words", "expat community abroad", "commons and clauses", "the artistic director", "an eclipse of the sun in public",
]


def test_notices_by_hand(spark):
    assert len({n for n, _ in NOTICES}) >= 150
    rows = [(i, text, want) for i, (text, want) in enumerate([*NOTICES, *((p, "") for p in PLAIN)])]
    got = license_scan.scan(spark.createDataFrame(rows, "id long, text string, want string")).collect()
    wrong = [(r["text"], r["want"], r["labels"]) for r in got if r["labels"] != r["want"]]
    assert not wrong, wrong


def test_overlaps_are_settled(spark):
    cases = [("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0-only"}), ("license: GPL-2.0 only", {"gpl-2.0-only"}), ("MIT License. GNU GPL v2 or later, MIT License", {"mit", "gpl-2.0-or-later"})]
    for (text, want), r in zip(cases, license_scan.scan(spark.createDataFrame([(t,) for t, _ in cases], "text string").coalesce(1)).collect(), strict=True):
        assert set(r["labels"].split(",")) == want, (text, r["labels"])

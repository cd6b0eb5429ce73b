"""Licence notices as people write them."""

import pytest

from lanternfish.llm import licenses

NOTICES = [
    ("This project is licensed under the MIT License - see the LICENSE.md file for details.", "MIT"), ("Licensed under the MIT license (see LICENSE).", "MIT"), ("released under the MIT License, https://example.org/mit", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint main() {}", "Apache-2.0,MIT"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"), ("License: MIT\nAuthor: someone", "MIT"), ('  "license": "ISC",\n  "main": "a.js"', "ISC"), ("BSD 3-Clause license", "BSD-3-Clause"),
    ("Copyright 2019 Example Inc, All rights reserved.", "All-Rights-Reserved"), ("Text is available under the Creative Commons Attribution-ShareAlike License.", "CC-BY-SA"), ("Content is available under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("This software is released under the BSD 2-Clause License.", "BSD-2-Clause"), ("The documentation is licensed under the Eclipse Public License 2.0.", "EPL-2.0"), ("This tool is dual licensed under GPLv2 and the MIT license.", "GPL-2.0,MIT"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT"),
    ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', "Apache-2.0"),
]
NONE = ["License: see the file", "She was released under the bridge (and the moon).", "available under the counter, https://example.org", "A permit | the rights | of MIT graduates", "licensed under", "License:", "SPDX-License-Identifier:", "", None]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(k, t) for k, t in enumerate([t for t, _ in NOTICES] + NONE)]
    return {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}


def test_notices(scanned):
    got = [(t, ",".join(scanned[k].licenses)) for k, (t, _) in enumerate(NOTICES)]
    assert got == NOTICES


def test_what_is_no_notice(scanned):
    assert [scanned[len(NOTICES) + k].licenses for k in range(len(NONE))] == [[] for _ in NONE]


def test_every_named_license_belongs_to_a_rule(spark):
    """Each name, after an opening and alone in a tag, gives exactly the licence whose rule holds its identifier."""
    rule = {i: n for n, _, seqs in licenses.RULES for q in (*seqs, *licenses.HEADER_RULES.get(n, ())) if len(q) == 1 for i in q}
    names = list(licenses.NAMED_LICENSES.items())
    rows = [(k, f"Words before.\n{lead}{n}{end}\nwords after") for k, (n, _) in enumerate(names) for lead, end in (("SPDX-License-Identifier: ", ""), ("This package is licensed under the ", " license (see below)."))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert [(r.doc_id, r.licenses) for r in got if r.licenses != [rule[names[r.doc_id][1]]]] == []

import duckdb
import pyarrow as pa
from llm.odd import empty_docs, odd_docs, odd_rows, stored

from storeloom.llm import oracles
from storeloom.llm.licenses import RULES, SENTENCES, SPDX_NAMES, scan_licenses

MIT = """Copyright (c) 2020 Someone. All rights reserved.

 * Permission is hereby granted, free of charge, to any person
 * obtaining a copy of this software and associated files.
 * The above copyright notice and this permission notice shall be included in all copies.
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted. Redistributions of source code must retain the above copyright notice. "
    "Redistributions in binary form must reproduce the above copyright notice. {extra}"
    'This software is provided by the authors "as is" and without warranty.'
)
ENDORSE = "Neither the name of X nor its contributors may be used to endorse or promote products. "
ADVERT = "All advertising materials mentioning features or use of this software must say so. "

MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS."""


CASES = [
    (MIT, "MIT"),
    (BSD.format(extra=""), "BSD-2-Clause"),
    ("Copyright (c) 1998, Someone.\nAll rights reserved.\n\n" + BSD.format(extra=""), "BSD-2-Clause"),
    (BSD.format(extra=ENDORSE), "BSD-3-Clause"),
    (BSD.format(extra=ADVERT + ENDORSE), "BSD-4-Clause"),
    ("Some text. Licensed under the Apache License, Version 2.0. More.", "Apache-2.0"),
    ("// SPDX-License-Identifier: Apache-2.0\nint main;", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    (
        "You can redistribute it under the terms of the GNU General Public License, either "
        "version 2 of the License, or (at your option) any later version.",
        "GPL-2.0-or-later",
    ),
    ("Released under the MIT License.\nAlso CC BY-NC 4.0 licensed.", "MIT,CC-BY-NC-4.0"),
    ("Licensed under CC BY 4.0. Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("The licence of a driver is no licence text.", ""),
    ("Nothing here.", ""),
    ("Released under the MIT\nLicense.", "MIT"),
    ("Dual licensed under the MIT License and Apache License, Version 2.0", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: Apache-2.0 OR MIT\n", "MIT,Apache-2.0"),
    ("// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: ISC\nx = 1", "MIT,ISC"),
    ("/* SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0 AND BSD-2-Clause) */", "BSD-2-Clause,GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later\nprint()", "GPL-3.0-or-later"),
    ("# SPDX-License-Identifier: GPL-3.0-only\nprint()", "GPL-3.0"),
    ("All rights reserved by the author of this page.", "All-Rights-Reserved"),
    ("Copyright (c) 2001 X. All rights reserved.", "All-Rights-Reserved"),
    ("Distributed under the 3-Clause BSD License and the ISC License.", "BSD-3-Clause,ISC"),
]

# Published texts and headers, one at least for each licence with rules of its own.
PUBLISHED = {
    "MIT": """Copyright 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT.""",
    "BSD-2-Clause": """Copyright (c) 2019, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of
   conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of
   conditions and the following disclaimer in the documentation.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "BSD-3-Clause": """Copyright (c) 2019, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright notice, this list.
    * Redistributions in binary form must reproduce the above copyright notice, this list.
    * Neither the name of the copyright holder nor the names of its contributors may be used to
      endorse or promote products derived from this software without specific prior permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "AS IS" AND ANY WARRANTIES ARE DISCLAIMED.""",
    "BSD-4-Clause": """Copyright (c) 1990 Someone.

Redistribution and use in source and binary forms, with or without modification, are permitted.
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
3. All advertising materials mentioning features or use of this software must display it.
4. Neither the name of X nor the names of its contributors may be used to endorse or promote it.
THIS SOFTWARE IS PROVIDED BY X "AS IS".""",
    "ISC": ISC,
    "Apache-2.0": """   Copyright 2021 Someone

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.""",
    "MPL-2.0": MPL,
    **{
        f"{name}{later}": f"""This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, {'either ' if later else ''}version {version} of the License{', or' if later else ''}
{'(at your option) any later version' if later else 'only'}.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

You should have received a copy of the GNU {kind}General Public License along with it."""
        for name, kind, version in (
            ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"),
            ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
        )
        for later in ("", "-or-later")
    },
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under Creative Commons Attribution-ShareAlike 4.0 International.",
    "CC-BY-ND-4.0": "Licensed under Creative Commons Attribution-NoDerivatives 4.0 International.",
    "CC-BY-NC-4.0": "Licensed under Creative Commons Attribution-NonCommercial 4.0 International.",
    "CC-BY-NC-SA-4.0": "Licensed under Attribution-NonCommercial-ShareAlike 4.0 International.",
    "CC-BY-NC-ND-4.0": "Licensed under Attribution-NonCommercial-NoDerivatives 4.0 International.",
    "CC0-1.0": "To the extent possible the author has waived all rights under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Public-Domain": "This file has been placed in the public domain.",
    "All-Rights-Reserved": "© 2022 Someone. All rights reserved.",
}


def in_sql(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    return {r[0]: tuple(r[1:]) for r in con.execute(oracles.license_scan()).fetchall()}


def both(spark, folder, rows):
    """The rows in Spark, which SQL has to give too."""
    got = {r.doc_id: r for r in scan_licenses(stored(spark, folder, rows)).collect()}
    assert {i: (r.sentence_ids, r.licenses, r.n_unknown) for i, r in got.items()} == in_sql(rows)
    return got


def test_known_texts(spark, tmp_path):
    got = both(spark, tmp_path / "d", [(i, t) for i, (t, _) in enumerate(CASES)])
    for i, (_, want) in enumerate(CASES):
        assert set(got[i].licenses.split(",")) == set(want.split(",")), (i, got[i])
    assert got[11].n_unknown == 1 and got[12].sentence_ids == ""


def test_every_licence_by_its_published_text(spark, tmp_path):
    names = list(PUBLISHED)
    assert set(names) == {name for name, _ in RULES}
    got = both(spark, tmp_path / "d", [(i, PUBLISHED[n]) for i, n in enumerate(names)])
    for i, name in enumerate(names):
        assert got[i].licenses == name, got[i]


def test_every_licence_by_its_tag(spark, tmp_path):
    got = both(spark, tmp_path / "d", [(i, f"# SPDX-License-Identifier: {n}\ncode") for i, n in enumerate(SPDX_NAMES)])
    for i, name in enumerate(SPDX_NAMES):
        assert got[i].licenses == name and got[i].n_unknown == 0


def test_unknown_tags_are_counted(spark, tmp_path):
    rows = [(1, "// SPDX-License-Identifier: Zlib OR MIT\n"), (2, "SPDX-License-Identifier: NASA-1.3")]
    got = both(spark, tmp_path / "d", rows)
    assert (got[1].licenses, got[1].n_unknown) == ("MIT", 1)
    assert (got[2].licenses, got[2].n_unknown) == ("", 1)


def test_random_mixtures_of_statements(spark, tmp_path):
    import random

    random.seed(21)
    texts = [*PUBLISHED.values(), *[t for t, _ in CASES], "v. 2 and/or", "(c) me", "\x01 \x02MITgrant\x03 licence"]
    rows = [(i, random.choice([" ", "\n", "\n\n"]).join(random.choices(texts, k=3))) for i in range(80)]
    both(spark, tmp_path / "d", rows)


def test_order_of_sentences_matters(spark, tmp_path):
    turned = (
        "Redistributions of source code must retain the above copyright notice. "
        "Redistribution and use in source and binary forms, with or without modification, are fine."
    )
    got = scan_licenses(stored(spark, tmp_path / "d", [(1, turned)])).first()
    assert got.sentence_ids == "<BSDsource><BSDgrant>" and got.licenses == "BSD-2-Clause"


def test_odd_and_empty(spark, tmp_path):
    got = scan_licenses(odd_docs(spark, tmp_path / "d")).collect()
    assert len(got) == len(odd_rows()) and all(r.licenses == "" for r in got)
    assert scan_licenses(empty_docs(spark, tmp_path / "e")).collect() == []


def test_rules_name_known_sentences():
    import re

    names = {n for n, _ in SENTENCES}
    for _, pattern in RULES:
        assert set(re.findall(r"<(\w+)>", pattern)) <= names


def test_standard_wordings_of_mpl_and_isc(spark, tmp_path):
    rows = [(0, MPL), (1, ISC), (2, "© 2020 Someone."), (3, "Attribution-ShareAlike 4.0 International.")]
    got = {r.doc_id: r for r in scan_licenses(stored(spark, tmp_path / "d", rows)).collect()}
    assert got[0].licenses == "MPL-2.0" and got[0].sentence_ids == "<MPL2ref><MPL2copy>"
    assert got[1].licenses == "ISC" and got[1].n_unknown == 0
    assert got[2].sentence_ids == "<Copyright>"
    assert got[3].licenses == "CC-BY-SA-4.0"

"""Licence notices as they are usually written: wrapped, in comments, whole."""

import re

import duckdb
import pytest

from quarry.llm import licenses
from quarry.llm.common import table

GPL = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later\nversion."
MIT = 'MIT License\n\nCopyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS".'
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
NAMES = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of\nthe License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n'
NOTICES = [
    (MIT, "MIT"),
    (GPL.format(":", ",", 3), "GPL-3.0-or-later"),
    (GPL.format(":", ",", 3).replace("\n", " "), "GPL-3.0-or-later"),
    (GPL.format(";", ";", 2), "GPL-2.0-or-later"),
    (BSD, "BSD-2-Clause"),
    (BSD + NAMES.format("the copyright holder"), "BSD-3-Clause"),
    (BSD + NAMES.format("Some\n   University"), "BSD-3-Clause"),
    (APACHE, "Apache-2.0"),
    ("Licensed under the MIT License\nCopyright A", "MIT"),
    ("later\nversion", None),
    (GPL.format(";", ";", "2.1").replace("program", "library").replace("General", "Lesser General"), "LGPL-2.1-or-later"),
    (GPL.format(":", ",", 3).replace("program", "library").replace("General", "Lesser General"), "LGPL-3.0-or-later"),
    (GPL.format(":", ",", 3).replace("General", "Affero General"), "AGPL-3.0-or-later"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0BSD"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"),
    ("To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide.", "CC0-1.0"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    (BSD + "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n", "BSD-4-Clause"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-\nShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    (BSD + NAMES.format("Google Inc."), "BSD-3-Clause"),
    (BSD + NAMES.format("Some Co. Ltd."), "BSD-3-Clause"),
    ('Licensed to the Apache Software Foundation (ASF) under one or more\ncontributor license agreements.  See the NOTICE file distributed with\nthis work for additional information regarding copyright ownership.\nThe ASF licenses this file to You under the Apache License, Version 2.0\n(the "License"); you may not use this file except in compliance with\nthe License.  You may obtain a copy of the License at\n\n   http://www.apache.org/licenses/LICENSE-2.0\n', "Apache-2.0"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR BSD-3-Clause)", "GPL-2.0-only"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n\n" + GPL.format(":", ",", 3), "GPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\n", "AGPL-3.0"),
    ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
    ("Licensed under the [MIT License](https://opensource.org/licenses/MIT).", "MIT"),
    ("It is free software under the GPL version 2 as published by the foundation.", "GPL-2.0"),
    ("Use of this source code is governed by a BSD-style license that can be\nfound in the LICENSE file.", "BSD-style"),
    ("This file is not licensed under the MIT license", None),
    ("She got a license to drive. Permission was not asked.", None),
]


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_notices(spark, sign):
    rows = [(k, "".join(f"{sign}{x}\n" for x in text.split("\n"))) for k, (text, _) in enumerate(NOTICES)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: name for k, (_, name) in enumerate(NOTICES)}
    assert all(re.search(licenses.SIGN, x) for x in licenses.ALL_SENTENCES) and all(re.search(licenses.SIGN, x) for x, _ in licenses.PHRASES)


def twin(path):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{path}')")
    return con.sql(licenses.OP2_SQL)


def test_op2_matches_its_twin(spark):
    sf = "/root/testdata/sf0.01"
    got, want = licenses.op2_license_scan(spark, sf), twin(f"{sf}/documents.parquet")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    assert got.columns == want.columns


def test_notices_match_the_twin(spark, tmp_path):
    rows = [(10 * k + j, "".join(f"{sign}{x}\n" for x in text.split("\n"))) for k, (text, _) in enumerate(NOTICES) for j, sign in enumerate(["", "# ", "> "])] + [(5000, None), (5001, ""), (5001, "MIT License"), (None, MIT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = licenses.op2_license_scan(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, twin(f"{tmp_path}/documents.parquet/*.parquet").fetchall()))
    assert licenses.scan(docs.limit(0)).count() == 0

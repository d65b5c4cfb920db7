"""Licences as they are published: wrapped, in comments, on one line; none of these texts comes from the rule base."""

import pytest

from sparkhound.llm import licences

MIT = """MIT License

Copyright (c) 2021 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2019, The Example Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION).
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """# Copyright 2020 The Example Authors.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.
 */
"""
GPL2 = """/* frob.c - frobnicate

   This program is free software; you can redistribute it and/or modify
   it under the terms of the GNU General Public License as published by
   the Free Software Foundation; either version 2 of the License, or
   (at your option) any later version.

   This program is distributed in the hope that it will be useful,
   but WITHOUT ANY WARRANTY; without even the implied warranty of
   MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. */
"""
GPL3 = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
"""
GPL2_ONLY = """;; This library is free software; you can redistribute it and/or modify it under the terms of the
;; GNU General Public License as published by the Free Software Foundation, version 2 of the License.
"""
LGPL = """    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.
"""
AGPL = """    Frob is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
GPL_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <http://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
ISC = """Copyright (c) 2015 Jane Roe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
CLASSPATH = """Linking this library statically or dynamically with other modules is making a combined work based on this library.
Thus, the terms and conditions of the GNU General Public License cover the whole combination.

As a special exception, the copyright holders of this library give you permission to link this library with independent modules
to produce an executable, regardless of the license terms of these independent modules, and to copy and distribute the resulting
executable under terms of your choice, provided that you also meet the terms of each of them.
"""
CASES = [
    (MIT, "MIT"), (" ".join(MIT.split()), "MIT"), ("\r\n".join(f" * {x}" for x in MIT.split("\n")), "MIT"), (MIT.replace("Jane Roe", "Jane Roe. All rights reserved."), "MIT"),
    (BSD.format(THIRD), "BSD-3-Clause"), (BSD.format(""), "BSD-2-Clause"), (BSD.format(THIRD).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"),
    (APACHE, "Apache-2.0"), (ASF, "Apache-2.0"), ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS", "Apache-2.0"),
    (GPL2, "GPL-2.0-or-later"), (GPL3, "GPL-3.0-or-later"), (GPL2_ONLY, "GPL-2.0-only"), (LGPL, "LGPL-2.1-or-later"), (AGPL, "AGPL-3.0-or-later"), (GPL_TEXT, "GPL-3.0"),
    (GPL2 + "\n" + CLASSPATH, "GPL-2.0-or-later,Classpath-exception-2.0"),
    (MPL, "MPL-2.0"), (ISC, "ISC"), (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), "0BSD"), (ZLIB, "Zlib"),
    ("This is free and unencumbered software released into the public domain.\n", "Unlicense"),
    ("// SPDX-License-Identifier: MIT\npackage main\n", "MIT"), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "MIT,Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", "GPL-2.0-only,Classpath-exception-2.0"),
    ("A heading\nReleased under the MIT License\nmore text", "MIT"), ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "MIT"),
    (MIT + "\n\n" + APACHE, "MIT,Apache-2.0"), ("x. " * 3000 + MIT, "MIT"),
    (None, ""), ("", ""), ("A driving licence is no permission to park.", ""), ("Not all rights reserved here are mine", ""), ("word " * 30_000, ""), (" " * 40_000 + "licence" + "*" * 40_000, ""),
    ("All rights reserved.", "Proprietary"), ("All rights reserved.\nAll rights reserved.", "Proprietary,Proprietary"),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t, "x", 7) for k, (t, _) in enumerate(CASES)] * 2, "doc_id long, text string, _ids string, _known int").repartition(3)
    rows = [r.asDict() for r in licences.licences(docs).collect()]
    assert len(rows) == 2 * len(CASES) and len({tuple(r.items()) for r in rows}) == len(CASES)  # repeated rows are reported each
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_published_text(found, k):
    want = CASES[k][1]
    assert found[k]["licences"] == want
    assert found[k]["n_licences"] == len(want.split(",")) * bool(want)


def test_empty_table(spark):
    assert licences.licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_sentence_has_a_key():
    import re

    for s in licences.SENTENCES:
        assert re.search(licences.IN_SENTENCE, s) and re.search(licences.IN_TEXT, s), s
        assert "*" in s or licences.plain(s) == s


def test_rules_in_their_order(spark):
    """Sequences by brute force: the first rule wins, leftmost first, used sentences are gone."""
    names = ["aaa licence one", "bbb licence two", "ccc licence three"]
    rules = [("ABC", (1, 2, 3)), ("AB", (1, 2)), ("A", (1,)), ("C", (3,))]
    texts = ["aaa licence one. bbb licence two. ccc licence three.", "aaa licence one. bbb licence two. aaa licence one.", "aaa licence one. some other. bbb licence two. ccc licence three", "aaa licence one. p q. p q. p q. bbb licence two.", "ccc licence three. bbb licence two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.licences(docs, names, rules).collect()}
    assert got == {0: "ABC", 1: "AB,A", 2: "ABC", 3: "A", 4: "C"}

"""The common licenses are known, and of templates with common words the right one is reported."""

from pyspark.sql import functions as F

from brindle.llm import licenses

GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
TEXTS = {
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-3.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.",
    "CC-BY-SA-4.0": "Text is licensed under CC BY-SA 4.0 here",
    "CC0-1.0": "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Example.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "GPL-2.0": GPL.format(";", "", ";", 2),
    "GPL-3.0": GPL.format(":", "", ",", 3),
    "AGPL-3.0": GPL.format(":", "Affero ", ",", 3),
    "LGPL-3.0": GPL.format(":", "Lesser ", ",", 3),
    "LGPL-2.1": GPL.replace("This program", "This library").format(";", "Lesser ", ";", "2.1"),
    "LGPL-2.0": GPL.replace("This program", "This library").format(";", "Library ", ";", 2),
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}


def test_each_notice_is_reported_as_itself(spark):
    texts = list(TEXTS.values()) + [TEXTS["GPL-2.0"] + "\n" + TEXTS["GPL-3.0"], TEXTS["GPL-3.0"].replace("redistribute", "spread") + " All rights reserved."]
    want = [{n} for n in TEXTS] + [{"GPL-2.0", "GPL-3.0"}, {"GPL-3.0", "proprietary"}]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.with_licenses(df, out="found", keep=["doc_id"]).select("doc_id", licenses.best(F.col("found")).alias("found")).collect()
    assert {r.doc_id: {m.license for m in r.found} for r in found} == dict(enumerate(want))


#: Notices as they stand in files: other wordings, comment signs, names filled in, one or two words changed.
OUTSIDE = [
    ("MIT", "/* Copyright (c) 2011 Jane Doe\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights\n * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n * copies of the Software, and to permit persons to whom the Software is\n * furnished to do so, subject to the following conditions: */"),
    ("MIT", "# THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL JANE DOE BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE AUTHOR ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD", "1. Redistributions of source code must retain the above copyright\n//    notice, this list of conditions, and the following disclaimer."),
    ("BSD-3-Clause", "* Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//   http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, this software is distributed under the License on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "GNU Example is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "Example is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "Example is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "The Example Library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Example Server is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "; This Source Code Form is subject to the terms of the Mozilla Public\n; License, v. 2.0. If a copy of the MPL was not distributed with this\n; file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Permission is granted to anyone to use this library for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this program, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-SA-3.0", "This page is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
    ("CC-BY-4.0", "Except where noted, this work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Example."),
    ("EPL-2.0", "* This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("LGPL-3.0", "Example is licensed under the LGPL, version 3, a copy of which is in the file COPYING."),
]


def test_recall_on_notices_as_files_have_them(spark):
    rng_words = " ".join(f"filler{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{rng_words}\n{t}\n{rng_words}") for i, (_, t) in enumerate(OUTSIDE)], "doc_id long, text string")
    found = {r.doc_id: {m.license for m in r.found} for r in licenses.with_licenses(df, out="found", keep=["doc_id"]).select("doc_id", licenses.best(F.col("found")).alias("found")).collect()}
    missed = [n for i, (n, _) in enumerate(OUTSIDE) if n not in found[i]]
    assert len(missed) <= len(OUTSIDE) // 10, missed
    # nothing is told of texts that only sound alike
    others = ["The license of the driver was free of charge, and permission was hereby granted by the officer.", "All rights of passage are reserved for members of the public."]
    df = spark.createDataFrame(list(enumerate(others)), "doc_id long, text string")
    assert all(not r.found for r in licenses.with_licenses(df, out="found").collect())

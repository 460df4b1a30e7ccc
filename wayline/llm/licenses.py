"""Licence scans by canonical digests, in DataFrame operations only.

A text is put into canonical form (case, punctuation, copyright lines, equivalent spellings), then its digest is
hash-joined to those of known licence texts, which go through the same form. Entire texts are compared: the whole document
with the licences, and each of its lines with the known one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence texts.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str, version: str) -> str:
    """The notice that files under a GNU licence carry."""
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either {version}, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\nYou should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."


#: Whole licences, and notices of licences that files carry as their header.
TEXTS = {
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n' + _AS_IS,
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL,
    "0BSD": "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL,
    "BSD-2-Clause": f"{_BSD_HEAD}\n\n{_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_TAIL}",
    "BSD-1-Clause": f"{_BSD_HEAD[:_BSD_HEAD.index(' 2. Redistributions')]}\n\n{_BSD_TAIL}",
    "MIT-0": 'MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n' + _AS_IS,
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS").replace("ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER", "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER") + "\n\nFor more information, please refer to <https://unlicense.org/>",
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    **{f"{k}-header": _gnu(*v) for k, v in {
        "GPL-2.0-or-later": ("GNU General Public License", "version 2 of the License"), "GPL-3.0-or-later": ("GNU General Public License", "version 3 of the License"),
        "LGPL-3.0-or-later": ("GNU Lesser General Public License", "version 3 of the License"), "AGPL-3.0-or-later": ("GNU Affero General Public License", "version 3 of the License"),
    }.items()},
}
#: One-line notices.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
}
#: Equivalent spellings after punctuation has gone: first is put as second.
SPELLINGS = (("licenc", "licens"), ("sub licens", "sublicens"), ("non infring", "noninfring"), ("acknowledgement", "acknowledgment"), ("https", "http"), ("favour", "favor"), ("per cent", "percent"), ("copyright owner", "copyright holder"))


#: A line of copyright: after the word a sign or a year must follow, or a sign begins the line. Lines of a body that only begin with the word stay.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:(?:©|\(c\))[ \t]|copyright[ \t]*(?:\(c\)|©|[:,]?[ \t]*\d{4})).*$"


def _spelled(canon: Column) -> Column:
    for a, b in SPELLINGS:
        canon = F.replace(canon, F.lit(a), F.lit(b))
    return canon


def canonical_lines(text: Column) -> Column:
    """Canonical form that still has line ends."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    return _spelled(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "))


def joined(canon: Column) -> Column:
    """The lines of a canonical form as one, words by single blanks; spellings that a line's end cut in two are put right."""
    return _spelled(F.trim(F.regexp_replace(canon, r"\s+", " ")))


def canonical(text: Column) -> Column:
    """Canonical form of a whole text."""
    return joined(canonical_lines(text))


def digest(canon: Column) -> Column:
    return F.sha2(canon, 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, kind, digest, length) of the texts and notices above: some twenty rows."""
    rows = [(k, "text", t) for k, t in TEXTS.items()] + [(k, "notice", t) for k, own in NOTICES.items() for t in own]
    known = spark.createDataFrame(rows, "license string, kind string, text string")
    canon = canonical(F.col("text"))
    return known.select("license", "kind", digest(canon).alias("digest"), F.length(canon).alias("length"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, whole, notices) for each row: the licence that the entire text is, or null, and the licences of its notice lines, sorted and joined by commas ('' if none).

    ``known`` (license, kind, digest, length): another table of any size, else the one above. Two licences with one
    digest give the first by name. A null or empty text holds none; texts of any length are taken whole; other columns are ignored. Rows that repeat id and text give equal rows; an
    empty table gives none.
    """
    if known is None:
        known, lengths = F.broadcast(known_licenses(docs.sparkSession)), [r[0] for r in known_licenses(docs.sparkSession).select("length").distinct().collect()]
    else:
        lengths = None
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), canonical_lines(F.col(text_col)).alias("canon"))
    whole = joined(F.col("canon"))
    lines = F.array_distinct(F.transform(F.split("canon", "\n"), lambda x: F.trim(x)))
    unit = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("canon"))
    units = base.select("id", "row", F.inline(F.concat(F.array(unit("text", whole)), F.transform(lines, lambda x: unit("notice", x))))).where("canon != ''")
    if lengths is not None:  # equal texts have equal lengths: spares the other digests
        units = units.where(F.length("canon").isin(lengths))
    hits = units.select("id", "row", "kind", digest(F.col("canon")).alias("digest")).join(known.select("license", "kind", "digest"), ["kind", "digest"])
    hits = hits.groupBy("id", "row").agg(
        F.min(F.when(F.col("kind") == "text", F.col("license"))).alias("whole"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "notice", F.col("license")))), ",").alias("notices"),
    )
    hits = hits.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "whole", "notices")
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("_r"))
    held = rows.join(hits, rows[id_col].eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_row")), "left")
    return held.select(id_col, "whole", F.coalesce("notices", F.lit("")).alias("notices"))

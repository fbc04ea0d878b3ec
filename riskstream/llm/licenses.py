"""License notices in documents, by MinHash bands over overlapping windows. DataFrame functions only.

Words are runs of letters and digits, A-Z lower-cased; shingles have five words.
Templates fall into classes by the power of two that holds their shingles, and
documents are cut into windows of twice that many shingles, each overlapping the next
by half, so that a notice lies whole in some window and is a quarter of it or more.
A window retrieves the templates that agree with it in one of `BANDS` MinHash values
(bands of one row): a whole notice is missed with probability (3/4)**48 = 1e-6 at most, one
of which 0.8 is there with 0.8**48 = 2e-5.  A retrieved template counts if the window contains
`CONTAINED` of its distinct shingles.

Only windows that hold any template shingle can count; documents and windows without
are passed over first, which loses nothing and spares nearly all hashing.  Templates
are broadcast as long as they have up to `SENT` shingles in all; with more, the
passing-over is left out and bands meet by a shuffled join.

Defined cases: null, empty or short texts hold nothing; rows of one doc_id are one
document, and so are all rows without id; extra columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
BANDS = 48
CONTAINED = 0.8
SENT = 20_000

# The wording of public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""

# The wording of whole public licenses, without their titles and copyright lines.
BODIES = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-text": f"{_CONDITIONS} {_WARRANTY}",
    "BSD-3-Clause-text": f"""{_CONDITIONS}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission. {_WARRANTY}""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
NOTICES |= BODIES


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "license_id string, text string")


def shingles(text: Column, k: int = WORDS) -> Column:
    """Hashes of all runs of k words, in order; an empty array for shorter texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # the words are bound once and then read by position
    return F.flatten(F.transform(F.array(parts), lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))))


def signature(of: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda band: F.array_min(F.transform(of, lambda x: F.xxhash64(x, band))))


def found(docs: DataFrame, templates: DataFrame, k: int = WORDS, bands: int = BANDS, contained: float = CONTAINED, sent: int = SENT) -> DataFrame:
    """doc_id, license_id, containment, n_windows, first_word of docs(doc_id, text) with templates(license_id, text)."""
    template = templates.select("license_id", F.array_distinct(shingles(F.col("text"), k)).alias("wanted")).where(F.size("wanted") > 0)
    template = template.withColumn("size", F.pow(F.lit(2), F.ceil(F.log2(F.size("wanted")))).cast("int"))
    total, sizes = template.agg(F.sum(F.size("wanted")), F.sort_array(F.collect_set("size"))).first()
    few = (total or 0) <= sent
    keys = template.select("license_id", "size", "wanted", F.posexplode(signature(F.col("wanted"), bands)).alias("band", "value"))

    held = docs.select("doc_id", shingles(F.col("text"), k).alias("held")).where(F.size("held") > 0)
    if few:
        known = sorted({x for (row,) in template.select("wanted").collect() for x in row})
        known = F.lit(known) if known else F.array().cast("array<bigint>")
        held = held.where(F.arrays_overlap("held", known))
    begin = lambda size: F.sequence(F.lit(0), F.floor((F.size("held") - 1) / size).cast("int"))
    windows = held.select("doc_id", "held", F.explode(F.lit(sizes or [1])).alias("size"))
    windows = windows.select("doc_id", "held", "size", F.explode(begin(F.col("size"))).alias("at"))
    windows = windows.select("doc_id", "size", (F.col("at") * F.col("size")).alias("first_word"), F.slice("held", F.col("at") * F.col("size") + 1, F.col("size") * 2).alias("held"))
    if few:
        windows = windows.where(F.arrays_overlap("held", known))
        keys = F.broadcast(keys)  # at most `sent` shingles, and `bands` values for each template
    banded = windows.select("doc_id", "size", "first_word", "held", F.posexplode(signature(F.col("held"), bands)).alias("band", "value"))
    met = banded.join(keys, ["size", "band", "value"])
    share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
    checked = met.select("doc_id", "license_id", "first_word", share.alias("containment")).where(F.col("containment") >= contained)
    return checked.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.count_distinct("first_word").alias("n_windows"), F.min("first_word").cast("long").alias("first_word"))

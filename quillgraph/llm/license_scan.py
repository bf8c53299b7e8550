"""Licence recognition by sentence rules, with DataFrame functions only and without a shuffle.

A text is cut into sentences, at sentence punctuation and blank lines; a line's end alone is no more than a space, and
comment marks are no words, so wrapped and commented licence texts give the same sentences as plain ones.  Each sentence is
normalised and looked up in a table of known licence sentences; one of several lines that isn't known as a whole is looked
up line by line, for notices that end with their line.  The identifiers found, in order, make up a sequence; a licence
rule is an ordered run of identifiers, and fits where the sequence has that run.  Sentences that are no licence sentences
don't interrupt a run.

Whether a sentence is known is one look into a hash set of all known ones; only for those that are, the table is read.

Defined results
* null or empty text, or no known sentence: no identifiers and no licences, both empty arrays
* a sentence that occurs again counts again; several fitting rules are all named, longer rules first
* a line of nothing but comment marks is a blank line
* repeated rows are scanned each, rows with null ids too; texts of any length are scanned whole
* an empty table gives an empty result; only the id and text columns are read, others may have any name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence identifiers and the licence sentences (normalised by `normal` below) that they stand for.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License",
    "mit-title-short": "MIT License",
    "mit-title-marked": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2-use": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-only": "either version 2 of the License.",
    "gpl2-later": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-version-2": "version 2 of the License.",
    "free-program": "This program is free software",
    "free-library": "This library is free software",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-later": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-terms-by": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-copy-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense-public": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl-copies": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "wtfpl-just": "You just DO WHAT THE FUCK YOU WANT TO.",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-notice": "Licensed under CC0 1.0.",
    "public-domain": "This work is in the public domain.",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0.",
    "ccby4-notice": "Licensed under CC BY 4.0.",
    "ccbysa4-short": "Licensed under CC BY-SA 4.0.",
    "ccbysa4-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbync4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccbynd4-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "ccbyncsa4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "ccbyncnd4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "rights-reserved": "All rights reserved.",
}

# Licences and the ordered runs of sentence identifiers that state them.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT-0", ["mit0-grant"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-old"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("Apache-2.0", ["apache2-header", "apache2-use", "apache2-copy"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("GPL-3.0-or-later", ["free-program", "gpl-terms", "gpl-warranty"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0-or-later", ["free-program", "gpl2-terms", "gpl2-later"]),
    ("GPL-2.0-only", ["free-program", "gpl2-terms", "gpl2-only"]),
    ("GPL-2.0-only", ["free-program", "gpl2-terms", "gpl2-version-2"]),
    ("LGPL-2.1-or-later", ["free-library", "lgpl21-terms", "lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-terms"]),
    ("AGPL-3.0-or-later", ["free-program", "agpl3-terms"]),
    ("AGPL-3.0-or-later", ["free-program", "agpl3-terms-by"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy-http"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("BSL-1.0", ["boost-distributed"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Unlicense", ["unlicense-public", "unlicense-anyone"]),
    ("WTFPL", ["wtfpl-copies", "wtfpl-just"]),
    ("CC0-1.0", ["cc0-waived"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("public-domain", ["public-domain"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-work"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("CC-BY-4.0", ["ccby4-work"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("CC-BY-ND-4.0", ["ccbynd4-work"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-work"]),
    ("CC-BY-NC-ND-4.0", ["ccbyncnd4-work"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-style"]),
    ("all-rights-reserved", ["rights-reserved"]),
]

#: What stands before a line's first word; blank lines, once that is gone; sentence punctuation before white space, which
#: stays, or the text's end.  The mark that takes an end's place is a control character.
LINE_HEAD, BLANK_LINES, SENTENCE_END, MARK = r"\n[^A-Za-z0-9\n]+", r"\n\n+", r"[.!?;:]+([\x09-\x0D ]|\z)", "\x01"
#: What is neither a-z nor 0-9 once A-Z are lower-cased separates words.
NOT_WORD = r"[^a-z0-9]+"


def normal(text: Column) -> Column:
    """Words of a lower-cased sentence, joined by single spaces."""
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal_text(text: str) -> str:
    """The same for a known sentence, which is short and of one piece."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return " ".join(kept.split())


def known_sentences(sentences: dict[str, str]) -> dict[str, str]:
    """Identifiers by normalised sentence."""
    return {normal_text(s): name for name, s in sentences.items()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(id, sentence_ids, licenses) for every document.

    ``sentences`` and ``rules`` are tables of the program, of fixed size; they become literals of the plan.
    """
    known = known_sentences(sentences or SENTENCES)
    fixed = sorted(rules or RULES, key=lambda r: (-len(r[1]), r[0], r[1]))
    least = min(map(len, known))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    is_known = lambda s: s.isin(list(known))  # noqa: E731  a hash set
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), LINE_HEAD, "\n"), BLANK_LINES, MARK), SENTENCE_END, MARK + "$1")
    # a sentence shorter than any known one can't be one; normalising never lengthens
    pieces = F.filter(F.split(lowered(cut), MARK), lambda s: F.length(s) >= least)
    lines = F.transform(pieces, lambda s: F.when(is_known(normal(s)), F.array(normal(s))).otherwise(F.filter(F.transform(F.split(s, "\n"), normal), is_known)))
    ids = F.transform(F.flatten(lines), lambda s: F.element_at(table, s))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select("id", F.coalesce(ids, F.expr("cast(array() as array<string>)")).alias("sentence_ids"))
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    fits = F.array_compact(F.array(*[F.when(F.contains(line, F.lit(f"|{'|'.join(run)}|")), F.lit(name)) for name, run in fixed]))
    return found.select(F.col("id").alias(id_col), "sentence_ids", F.array_distinct(fits).alias("licenses"))

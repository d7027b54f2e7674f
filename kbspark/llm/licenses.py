"""Licence scans by sentences and rules.

A text is cut into sentences at marks (one of ``. ! ? ; :``) before white space, at blank lines, and at lines without a letter or digit;
line ends inside a sentence only part words, so wrapped licences and comment leaders do not matter. Sentences are normalised (lower-case letters,
digits and plus signs, one space between words), and known licence sentences get their identifier. A sentence over
several lines that is not known as a whole is also looked up line by line, as notices often stand on a line without a mark before it. Known are the sentences
of ``SENTENCES``, some with any owner's name in a slot, identifiers of ``LICENSES`` after an SPDX tag, and notices (``this project is licensed under the ... license``) that name one of ``LICENSES``. A rule is an
ordered list of identifiers; it matches where they follow each other in the document's sequence of known
sentences, whatever other sentences lie between. A place that a longer rule takes does not count for rules that it contains.
All is DataFrame code on each row alone: no shuffle.

Null and empty texts match nothing. Repeated rows match each. An empty table gives an empty table. A very long text is one row's arrays of
sentences, some four times its size. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SPDX identifiers of public licences, and names by which notices call them.
LICENSES = {
    "0BSD": ["bsd zero clause", "zero clause bsd"],
    "AFL-3.0": ["academic free license version 3 0"],
    "AGPL-3.0-only": ["agpl 3 0", "agplv3", "gnu affero general public license version 3", "gnu affero general public license v3 0"],
    "AGPL-3.0-or-later": ["gnu affero general public license version 3 or later", "agpl 3 0+"],
    "Apache-1.1": ["apache software license version 1 1"],
    "Apache-2.0": ["apache license version 2 0", "apache 2 0", "apache license 2 0", "apache license v2 0", "apache"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "BlueOak-1.0.0": ["blue oak model license 1 0 0"],
    "BSD-1-Clause": ["1 clause bsd"],
    "BSD-2-Clause": ["2 clause bsd", "simplified bsd", "freebsd"],
    "BSD-3-Clause": ["3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "BSD-3-Clause-Clear": ["clear bsd"],
    "BSD-4-Clause": ["4 clause bsd", "original bsd"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost"],
    "CC-BY-2.0": ["cc by 2 0", "creative commons attribution 2 0"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0 unported"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "cddl 1 0"],
    "CDDL-1.1": ["common development and distribution license version 1 1", "cddl 1 1"],
    "CECILL-2.1": ["cecill 2 1"],
    "CPL-1.0": ["common public license version 1 0"],
    "ECL-2.0": ["educational community license version 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0"],
    "EUPL-1.1": ["european union public licence version 1 1", "eupl 1 1"],
    "EUPL-1.2": ["european union public licence version 1 2", "eupl 1 2"],
    "GFDL-1.3-only": ["gnu free documentation license version 1 3"],
    "GPL-1.0-only": ["gnu general public license version 1"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2 0", "gpl 2 0", "gplv2"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gpl 2 0+", "gplv2+"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3 0", "gpl 3 0", "gplv3"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gpl 3 0+", "gplv3+"],
    "HPND": ["historical permission notice and disclaimer"],
    "IPL-1.0": ["ibm public license version 1 0"],
    "ISC": ["isc"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"],
    "LGPL-2.1-or-later": ["gnu lesser general public license version 2 1 or later", "lgpl 2 1+"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"],
    "LGPL-3.0-or-later": ["gnu lesser general public license version 3 or later", "lgpl 3 0+"],
    "LPPL-1.3c": ["latex project public license version 1 3c"],
    "MIT": ["mit"],
    "MIT-0": ["mit no attribution"],
    "MPL-1.1": ["mozilla public license version 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "MS-PL": ["microsoft public license"],
    "MS-RL": ["microsoft reciprocal license"],
    "MulanPSL-2.0": ["mulan psl v2", "mulan permissive software license version 2"],
    "NCSA": ["university of illinois ncsa open source license"],
    "ODbL-1.0": ["open data commons open database license v1 0", "open database license"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1"],
    "OSL-3.0": ["open software license version 3 0"],
    "PostgreSQL": ["postgresql"],
    "PSF-2.0": ["python software foundation license version 2"],
    "Python-2.0": ["python license 2 0"],
    "Ruby": ["ruby"],
    "Unlicense": ["unlicense"],
    "UPL-1.0": ["universal permissive license version 1 0", "upl 1 0"],
    "Vim": ["vim"],
    "W3C": ["w3c software notice and license"],
    "WTFPL": ["do what the fuck you want to public license", "wtfpl"],
    "X11": ["x11"],
    "Zlib": ["zlib"],
    "ZPL-2.1": ["zope public license version 2 1"],
}
#: Sentences of public licences, by identifier, as they read when normalised.
SENTENCES = {
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache2-header": "licensed under the apache license version 2 0 the license",
    "apache2-compliance": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-limits": "see the license for the specific language governing permissions and limitations under the license",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "either-2": "either version 2 of the license or at your option any later version",
    "either-2.1": "either version 2 1 of the license or at your option any later version",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "gpl-free": "this program is free software",
    "gpl-published": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only-terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-zero-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-disclaimer": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "lgpl-free": "this library is free software",
    "lgpl-published": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-zero-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "ofl-grant": "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions",
    "rights": "all rights reserved",
    "spdx": "spdx license identifier",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl-terms": "you just do what the fuck you want to",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented",
}
#: Fixed values: (rule, licence, identifiers in order) of texts and headers; notices and SPDX tags of ``LICENSES`` are rules of their own.
TEXTS = [
    ("agpl3-header", "AGPL-3.0-or-later", ["gpl-free", "agpl3-terms", "gpl-hope"]),
    ("all-rights", "LicenseRef-all-rights-reserved", ["rights"]),
    ("apache2-header", "Apache-2.0", ["apache2-header", "apache2-compliance", "apache2-copy"]),
    ("boost-text", "BSL-1.0", ["boost-grant"]),
    ("bsd2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd4-text", "BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("cc-by-4-long", "CC-BY-4.0", ["cc-by-long"]),
    ("cc0-long", "CC0-1.0", ["cc0"]),
    ("epl2-header", "EPL-2.0", ["epl2-terms"]),
    ("gpl2-header", "GPL-2.0-or-later", ["gpl-free", "gpl-published", "either-2", "gpl-hope"]),
    ("gpl2-header-comma", "GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl-hope"]),
    ("gpl2-only-header", "GPL-2.0-only", ["gpl-free", "gpl2-only-terms"]),
    ("gpl3-header", "GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope"]),
    ("isc-text", "ISC", ["isc-grant", "isc-disclaimer"]),
    ("0bsd-text", "0BSD", ["isc-zero-grant", "isc-disclaimer"]),
    ("lgpl21-header", "LGPL-2.1-or-later", ["lgpl-free", "lgpl-published", "either-2.1"]),
    ("lgpl21-header-comma", "LGPL-2.1-or-later", ["lgpl-free", "lgpl21-terms"]),
    ("lgpl3-header", "LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms"]),
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "mit-as-is"]),
    ("mit0-text", "MIT-0", ["mit-zero-grant", "mit-as-is"]),
    ("mpl2-header", "MPL-2.0", ["mpl2-terms"]),
    ("ofl-text", "OFL-1.1", ["ofl-grant"]),
    ("unlicense-text", "Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("wtfpl-text", "WTFPL", ["wtfpl-terms"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-grant", "zlib-origin"]),
]
#: Sentences with a slot: their beginning, how they read with any owner's name in the slot, and how they are known. An owner whose name
#: ends a sentence, as one with ``Inc.``, leaves only what comes after the name.
CONTRIBUTORS = "nor the names? of (?:(?:its|the|their|any|other|any other) )?contributors may be used"
SLOTS = [
    ("neither the name", f"^neither the names? of [a-z0-9+ ]{{1,300}}? {CONTRIBUTORS}", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("nor the name", f"^{CONTRIBUTORS}", "neither the name of the copyright holder nor the names of its contributors may be used"),
]
#: How a notice reads around the licence's name, when normalised.
NOTICE = r"^(?:(?:this|the) (?:work|project|program|software|library|package|code|source code|file|document|content|text|site) is |it is )?(?:released|licensed|distributed|available|made available|published|provided) under (?:the terms of )?(?:the |an? )?(.+?)(?: licen[cs]e)?$"
#: Where sentences end, and what separates the words of a normalised one; two signs that texts do not have.
SENTENCE_END = r"[.!?;:][ \t\f\r\n]+|\n[^a-z0-9+\n]*\n"
NO_WORD, LINE_END = "[^a-z0-9+\x01\n]+", " ?\n[ \n]*"
CUT, LINE = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str) -> str:
    return " ".join(re.findall("[a-z0-9+]+", text.lower()))


def names() -> dict[str, str]:
    """Licences by the names that notices and tags give them."""
    out = {normal(i): i for i in LICENSES}
    for i, called in LICENSES.items():
        for name in called:
            out.setdefault(name, i)
            out.setdefault(name.removesuffix(" license").removesuffix(" licence"), i)
    return out


def rules() -> list[tuple[str, str, list[str]]]:
    """All rules (name, licence, identifiers)."""
    tags = [(f"spdx:{i}", i, ["spdx", f"name:{i}"]) for i in LICENSES]
    return [*TEXTS, *((f"notice:{i}", i, [f"notice:{i}"]) for i in LICENSES), *tags]


def sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def covering(ids: list[str], every: list) -> list[str]:
    """The sequences of longer rules that contain a rule's, the longest first."""
    own = sequence(ids)
    return sorted({sequence(x) for _, _, x in every if own in sequence(x) and sequence(x) != own}, key=lambda s: (-len(s), s))


def taken(ids: str) -> str:
    """What stands in the place of a sequence that a longer rule took: as long, with as many signs, but no identifier."""
    return re.sub("[^<>]", ".", ids)


def sentences(text: Column) -> Column:
    """The normalised sentences in order, with a sign for line ends; those without a word are empty."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, SENTENCE_END, CUT), NO_WORD, " "), LINE_END, LINE)
    return F.transform(F.split(cut, CUT), lambda s: F.btrim(s, F.lit(" " + LINE)))


def identified(text: Column) -> Column:
    """array<struct<no, id>> of the known sentences; ``no`` counts all sentences from 0."""
    called = names()
    exact = {sentence: i for i, sentence in SENTENCES.items()} | {name: f"name:{i}" for name, i in called.items()}
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    longest = max(map(len, called))
    whole, notices = table(exact), table({name: f"notice:{i}" for name, i in called.items()})

    def known(s: Column) -> Column:
        for begin, pattern, filled in SLOTS:
            s = F.when(F.startswith(s, F.lit(begin)), F.regexp_replace(s, pattern, filled)).otherwise(s)
        name = F.when(F.contains(s, F.lit(" under ")), F.regexp_extract(s, NOTICE, 1))
        name = F.when(F.length(name) <= longest, name)
        return F.coalesce(F.when(s.isin(list(exact)), F.try_element_at(whole, s)), F.when(name.isin(list(called)), F.try_element_at(notices, name)))

    def of(s: Column, i: Column) -> Column:
        joined = known(F.replace(s, F.lit(LINE), F.lit(" ")))
        lines = F.filter(F.transform(F.split(s, LINE), lambda x: known(F.trim(x))), lambda x: x.isNotNull())
        found = F.when(joined.isNotNull(), F.array(joined)).when(F.contains(s, F.lit(LINE)), lines).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda x: F.struct(i.cast("int").alias("no"), x.alias("id")))

    return F.flatten(F.transform(sentences(text), of))


def scan(df: DataFrame, text: str = "text", every: list | None = None) -> DataFrame:
    """A row for each input row and rule that matches: its columns without ``text``, and rule, license,
    ``sentence`` (the number of the first sentence of the first match) and ``matches``, their number."""
    every = rules() if every is None else every
    found = "__found"
    over = {name: covering(ids, every) for name, _, ids in every}
    longer = lambda name: F.array(*[F.struct(F.lit(s).alias("ids"), F.lit(taken(s)).alias("taken")) for s in over[name]]) if over[name] else F.array().cast("array<struct<ids:string,taken:string>>")
    rule = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(license_).alias("license"), F.lit(sequence(ids)).alias("ids"), longer(name).alias("over")) for name, license_, ids in every])
    rows = df.withColumn(found, identified(F.col(text))).drop(text).where(F.size(found) > 0)
    rows = rows.withColumn("__line", F.array_join(F.transform(F.col(found), lambda s: F.concat(F.lit("<"), s["id"], F.lit(">"))), ""))
    rows = rows.withColumn("__rule", F.explode(F.filter(rule, lambda r: F.contains(F.col("__line"), r["ids"]))))
    rows = rows.withColumn("__line", F.aggregate("__rule.over", F.col("__line"), lambda line, o: F.replace(line, o["ids"], o["taken"]))).where(F.contains("__line", F.col("__rule.ids")))
    before = F.split_part(F.col("__line"), F.col("__rule.ids"), F.lit(1))
    place = F.length(before) - F.length(F.regexp_replace(before, "<", ""))
    out = {"rule": F.col("__rule.rule"), "license": F.col("__rule.license"), "sentence": F.element_at(found, place + 1)["no"], "matches": ((F.length("__line") - F.length(F.replace(F.col("__line"), F.col("__rule.ids"), F.lit("")))) / F.length("__rule.ids")).cast("int")}
    return rows.select(*[c for c in df.columns if c != text and c not in out], *[v.alias(k) for k, v in out.items()])


def scan_sql() -> str:
    """The same over ``documents`` in SQL, with sentences as rows and identifier sequences as text."""
    every, called = rules(), names()
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)
    deep = max(len(covering(ids, every)) for _, _, ids in every)
    table = [(name, license_, sequence(ids), *[x for s in [*covering(ids, every), *["<none>"] * deep][:deep] for x in (s, taken(s))]) for name, license_, ids in every]
    columns = ", ".join(f"o{k}, t{k}" for k in range(deep))
    line = "line"
    for k in range(deep):
        line = f"replace({line}, o{k}, t{k})"
    slots = "s"
    for begin, pattern, filled in SLOTS:
        slots = f"case when starts_with({slots}, '{begin}') then regexp_replace({slots}, '{pattern}', '{filled}') else {slots} end"
    return f"""
    with cut as (
      select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '{SENTENCE_END}', chr(1), 'g'), '[^a-z0-9+\\x01\\n]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(2), 'g'), chr(1)) as parts
      from documents where text is not null
    ), sentences as (select doc_id, trim(unnest(parts), ' ' || chr(2)) as s, unnest(range(len(parts))) as no from cut),
    whole(sentence, id) as (values {quoted([*((s, i) for i, s in SENTENCES.items()), *((n, f"name:{i}") for n, i in called.items())])}), called(name, license) as (values {quoted(called.items())}),
    named as (
      select distinct s, coalesce(w.id, 'notice:' || c.license) as id from (select distinct unnest(list_concat([replace(s, chr(2), ' ')], list_transform(string_split(s, chr(2)), lambda x: trim(x)))) as s from sentences)
      left join whole w on w.sentence = {slots} left join called c on c.name = regexp_extract(s, '{NOTICE}', 1) where w.id is not null or c.license is not null
    ), joined as (select doc_id, no, sentences.s, n.id from sentences left join named n on n.s = replace(sentences.s, chr(2), ' ')),
    found as (
      select doc_id, no, 0 as k, id from joined where id is not null
      union all select doc_id, no, k, n.id from (select doc_id, no, unnest(string_split(s, chr(2))) as x, unnest(range(len(string_split(s, chr(2))))) as k from joined where id is null and contains(s, chr(2))) l join named n on n.s = trim(x)
    ), rules(rule, license, ids, {columns}) as (values {quoted(table)}),
    seq as (select doc_id, string_agg('<' || id || '>', '' order by no, k) as line, list(no order by no, k) as nos from found group by doc_id),
    hits as (select doc_id, nos, rule, license, ids, {line} as line from seq join rules on contains(line, ids))
    select doc_id, rule, license,
           cast(nos[length(split_part(line, ids, 1)) - length(replace(split_part(line, ids, 1), '<', '')) + 1] as integer) as sentence,
           cast((length(line) - length(replace(line, ids, ''))) / length(ids) as integer) as matches
    from hits where contains(line, ids)"""

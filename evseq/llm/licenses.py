"""License scans: template markup compiled to token automata.

A template is words, `[[optional]]` regions and `{{name:most}}` replaceable regions (up to `most` words, any). It compiles to a
nondeterministic automaton over words; a text is accepted at a place if the mandatory words match exactly, with each optional
region either whole or absent. Automata start only where their first mandatory words stand, so ordinary text costs one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from evseq.llm import common

#: Phrases and labels of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What the common permissive licenses disclaim, in the words of each.
MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
    merchantability fitness for a particular purpose and {{non:1}} noninfringement in no event shall the {{authors:4}} be liable for any claim
    damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
    the use or other dealings in the software"""
BSD_WARRANTY = """this software is provided by {{the holders:12}} as is and any express or implied warranties including but not limited to the
    implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{the holders:12}} be liable for
    any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
    services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
    liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility
    of such damage"""
BSD_TERMS = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
    are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution"""
GNU_WARRANTY = """[[{{program:4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
    merchantability or fitness for a particular purpose see the gnu {{kind:2}} general public license for more details]]"""
#: Wording of public licenses and of the notices that apply them, whole, as templates.
WHOLE = {
    "mit": f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        {{{{quote:1}}}} software {{{{quote:1}}}} to deal in the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject
        to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in
        all copies or substantial portions of the software {MIT_WARRANTY}""",
    "mit-0": f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        {{{{quote:1}}}} software {{{{quote:1}}}} to deal in the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        {MIT_WARRANTY}""",
    "isc": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is and {{the author:4}} disclaims
        all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall
        {{the author:4}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use
        data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "0bsd": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted the software is
        provided as is and {{the author:4}} disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall {{the author:4}} be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
        arising out of or in connection with the use or performance of this software""",
    "bsd-2-clause": f"{BSD_TERMS} {BSD_WARRANTY}",
    "bsd-3-clause": f"""{BSD_TERMS} [[3]] neither the name of {{{{the holder:12}}}} nor the names of {{{{its:2}}}} contributors may be used to endorse or
        promote products derived from this software without specific prior written permission {BSD_WARRANTY}""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the {{authors:3}} be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not
        be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the
        product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not
        be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
        [[in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law]] the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim
        damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
        the use or other dealings in the software""",
    "bsl-1.0": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare
        derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the
        copyright notices in the software and this entire statement including the above license grant this restriction and the following
        disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies
        or derivative works are solely in the form of machine executable object code generated by a source language processor the software is
        provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for
        a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for
        any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or
        other dealings in the software""",
    "apache-2": """licensed under the apache license version 2 0 the {{quote:1}} license {{quote:1}} you may not use this {{file:2}} except in compliance
        with the license [[you may obtain a copy of the license at {{address:8}}]] unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see
        the license for the specific language governing permissions and limitations under the license""",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
        file you can obtain one at {{address:6}}""",
    "epl-2.0": """this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] 2 0 which {{is:2}}
        available at {{address:8}}""",
    "gpl-2": f"""is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation either version 2 of the license [[or at your option any later version]] {GNU_WARRANTY}""",
    "gpl-3": f"""is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation either version 3 of the license [[or at your option any later version]] {GNU_WARRANTY}""",
    "lgpl-2.1": f"""is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by
        the free software foundation either version 2 1 of the license [[or at your option any later version]] {GNU_WARRANTY}""",
    "lgpl-3": f"""is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by
        the free software foundation either version 3 of the license [[or at your option any later version]] {GNU_WARRANTY}""",
    "agpl-3": f"""is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by
        the free software foundation either version 3 of the license [[or at your option any later version]] {GNU_WARRANTY}""",
    "cc0": """to the extent possible under law {{the person:12}} has waived all copyright and related or neighboring rights to {{the work:12}}""",
}
#: The usual ways to name a license, and the labels they stand for.
SHORT = {
    "[[released]] [[licensed]] [[distributed]] under [[the terms of]] the mit license": "mit", "under [[the terms of]] the apache license [[version]] 2 [[0]]": "apache-2",
    "under [[the terms of]] the gnu general public license [[version]] 3": "gpl-3", "under [[the terms of]] the gnu general public license [[version]] 2": "gpl-2",
    "under [[the terms of]] the gnu lesser general public license [[version]] 3": "lgpl-3", "under [[the terms of]] the gnu lesser general public license [[version]] 2 1": "lgpl-2.1",
    "under [[the terms of]] the gnu affero general public license [[version]] 3": "agpl-3", "under [[the terms of]] the mozilla public license [[version]] [[v]] 2 [[0]]": "mpl-2.0",
    "under [[the terms of]] the [[new]] bsd 3 clause license": "bsd-3-clause", "under [[the terms of]] the [[simplified]] bsd 2 clause license": "bsd-2-clause", "under [[the terms of]] the isc license": "isc",
    "under [[the terms of]] the boost software license [[version]] 1 [[0]]": "bsl-1.0", "under [[the terms of]] the zlib license": "zlib", "cc0 1 0 [[universal]]": "cc0",
}
#: Versions of Creative Commons licenses; their parts and the parts' names in full.
CC_VERSIONS = "[[1 0]] [[2 0]] [[2 5]] [[3 0]] [[4 0]]"
CC_PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}


def creative_commons() -> dict[str, str]:
    """Of each combination that there is, its abbreviation and its name in full, as short forms."""
    out = {}
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label = "-".join(("cc", *parts))
        full = " ".join(CC_PARTS[p] for p in parts)
        out |= {f"{label.replace('-', ' ')} {CC_VERSIONS}": label, f"creative commons {full} {CC_VERSIONS} [[international]] [[generic]] [[unported]] license": label}
    return out


#: Every template and its label; whether it is a whole license or notice.
TEMPLATES = WHOLE | {f"short {k}": t for k, t in enumerate(SHORT | creative_commons())}
LABELS = {f"short {k}": label for k, label in enumerate((SHORT | creative_commons()).values())}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"

#: A-Z lowered, and every byte that ends a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` made a space.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """States 0 to `final`; step[s] maps a word to next states, skip[s] are reached without a word, any word loops over `wild`."""

    label: str
    final: int = 0
    step: list[dict[bytes, set[int]]] = field(default_factory=lambda: [{}])
    skip: list[set[int]] = field(default_factory=lambda: [set()])
    wild: list[set[int]] = field(default_factory=lambda: [set()])

    def add(self) -> int:
        self.step.append({})
        self.skip.append(set())
        self.wild.append(set())
        return len(self.step) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.skip[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return frozenset(seen)


def compile_template(label: str, markup: str) -> Automaton:
    a, at, opened = Automaton(label), 0, []
    for part in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", markup.lower()):
        if part == "[[":
            opened.append(at)
        elif part == "]]":
            a.skip[opened.pop()].add(at)
        elif part.startswith("{{"):
            start = at
            hops = [start]
            for _ in range(int(part.strip("{}").rpartition(":")[2])):
                new = a.add()
                a.wild[at].add(new)
                at = new
                hops.append(at)
            for h in hops[:-1]:
                a.skip[h].add(at)
        else:
            for w in words(part.encode()):
                new = a.add()
                a.step[at].setdefault(w, set()).add(new)
                at = new
    if opened:
        raise ValueError(f"unclosed [[ in {label}")
    a.final = at
    return a


class Scanner:
    """Subset construction on demand: sets of states become numbered states when first met."""

    def __init__(self, automata: list[Automaton]):
        self.automata = automata
        self.known: list[dict[tuple[frozenset[int], bytes], frozenset[int]]] = [{} for _ in automata]
        self.starts: dict[bytes, list[int]] = {}
        self.initial = [a.closed({0}) for a in automata]
        for k, a in enumerate(automata):
            for s in self.initial[k]:
                if a.wild[s]:
                    continue
                for w in a.step[s]:
                    self.starts.setdefault(w, []).append(k)
        self.least = [self._least(a) for a in automata]

    @staticmethod
    def _least(a: Automaton) -> set[bytes]:
        """Words that every accepted text has: those on every way, found by leaving each out."""
        out = set()
        for w in {w for step in a.step for w in step}:
            seen, todo = {0}, [0]
            while todo:
                s = todo.pop()
                for x in a.skip[s] | a.wild[s] | {y for v, ys in a.step[s].items() if v != w for y in ys}:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if a.final not in seen:
                out.add(w)
        return out

    def match(self, k: int, tokens: list[bytes], at: int) -> int:
        """Where the longest accepted run that begins at this word ends; -1 if none is accepted."""
        a, known, state, end = self.automata[k], self.known[k], self.initial[k], -1
        for i in range(at, len(tokens)):
            key = (state, tokens[i] if any(tokens[i] in a.step[s] for s in state) else b"")
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                known[key] = a.closed({y for s in state for y in a.step[s].get(key[1], ())} | {y for s in state for y in a.wild[s]})
            state = known[key]
            if not state:
                break
            if a.final in state:
                end = i + 1
        return end

    def scan(self, tokens: list[bytes]) -> list[tuple[str, int, int]]:
        have = set(tokens)
        live = [k for k, need in enumerate(self.least) if need <= have]
        found = []
        if live:
            for w, ks in self.starts.items():
                if w in have and (ks := [k for k in ks if k in live]):
                    for i in positions(tokens, w):
                        for k in ks:
                            if (end := self.match(k, tokens, i)) > 0:
                                found.append((self.automata[k].label, i, end))
        # Of what begins at one word only the longest: "cc by nc" isn't named where "cc by nc sa" is.
        longest: dict[int, int] = {}
        for _, i, end in found:
            longest[i] = max(longest.get(i, 0), end)
        return sorted({x for x in found if x[2] == longest[x[1]]}, key=lambda x: (x[1], x[2], x[0]))


def positions(tokens: list[bytes], word: bytes) -> list[int]:
    out, i = [], -1
    try:
        while True:
            i = tokens.index(word, i + 1)
            out.append(i)
    except ValueError:
        return out


def phrase_places(tokens: list[bytes], phrase: list[bytes]) -> list[int]:
    rare = max(range(len(phrase)), key=lambda k: len(phrase[k]))
    return [i - rare for i in positions(tokens, phrase[rare]) if i >= rare and tokens[i - rare : i - rare + len(phrase)] == phrase]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of docs.

    base: places of the contract's phrases; labels: those and the labels of accepted templates. spans: the accepted places, in
    words; of those that begin at one word, the longest. score: 1 if a whole license text or notice is accepted, 0.5 if only phrases or
    short forms are, else 0. Null, empty
    or wordless text: no words, no labels, null first and last word. Rows are independent: repeated rows give equal results.
    """
    marked = TEMPLATES if templates is None else templates
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
    scanner = None

    def one(batch: pa.RecordBatch) -> dict:
        nonlocal scanner
        if scanner is None:
            scanner = Scanner([compile_template(k, v) for k, v in marked.items()])
        cols: dict[str, list] = {f: [] for f in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in common.texts(batch.column(1)):
            tokens = words(text)
            have = set(tokens)
            places, base = [], set()
            for phrase, label in phrases:
                if have.issuperset(phrase) and (got := phrase_places(tokens, phrase)):
                    places += got
                    base.add(label)
            spans = scanner.scan(tokens)
            labels = base | {LABELS.get(s[0], s[0]) for s in spans}
            whole = any(s[0] not in LABELS for s in spans)
            for name, value in (
                ("n_words", len(tokens)), ("n_base", len(places)), ("first_word", min(places, default=None)), ("last_word", max(places, default=None)),
                ("base_labels", ",".join(sorted(base))), ("labels", ",".join(sorted(labels))), ("score", 1.0 if whole else 0.5 if labels else 0.0),
                ("spans", [{"label": LABELS.get(n, n), "start": i, "end": j} for n, i, j in spans]),
            ):
                cols[name].append(value)
        return cols | {"doc_id": batch.column(0)}

    return common.map_rows(docs.select("doc_id", "text"), one, SCHEMA)

import textwrap

from rangeloom.llm.licenses import MORE_RULES, MORE_SENTENCES, RULES, SENTENCES, every_rule, licences, normal


def test_holders_and_usual_licences(spark):
    bsd = [SENTENCES[i] for i in (70, 71, 72, 73, 74)]
    third = "Neither the name of Google Inc. nor the names of its\n * contributors may be used to endorse or promote products derived from\n * this software without specific prior written permission."
    named = [*bsd[:3], third, bsd[4].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"", "GOOGLE INC. ``AS IS''")]
    lgpl = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
    texts = {
        1: ("\n".join(bsd), "BSD-3-Clause"), 2: ("\n".join(named), "BSD-3-Clause"), 3: ("\n".join([*bsd[:3], named[4]]), "BSD-2-Clause"), 4: (lgpl, "LGPL-2.1"),
        5: ("   Apache License\n  Version 2.0, January 2004\n", "Apache-2.0"), 6: ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "GPL-3.0"),
        7: ("Eclipse Public License - v 2.0\n", "EPL-2.0"), 8: ("The Artistic License 2.0\n", "Artistic-2.0"), 9: ("\n".join([*bsd[:3], "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."]), "BSD-3-Clause"),
    }
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in licences(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in texts.items()} and got[2][1] == got[1][1] == 5


ALL = SENTENCES | MORE_SENTENCES
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
#: Whole texts: paragraphs as their licences have them, with holders and years.
WHOLE = {
    "MIT": ["The MIT License (MIT)", "Copyright (c) 2019 Jane Doe", ALL[1], ALL[2], f"{AS_IS} IN NO EVENT SHALL ACME CORP. BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "BSD-3-Clause": [
        "Copyright (c) 2009, Example Labs, Inc.\nAll rights reserved.", ALL[70], f"1. {ALL[71]}", f"2. {ALL[72]}", f"3. {ALL[73].replace('the copyright holder', 'Example Labs, Inc.')}",
        'THIS SOFTWARE IS PROVIDED BY EXAMPLE LABS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL EXAMPLE LABS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS).',
    ],
    "BSD-4-Clause": ["Copyright (c) 1999 The Foo Group", ALL[70], f"1. {ALL[71]}", f"2. {ALL[72]}", f"3. {ALL[260]} This product includes software developed by the Foo Group.", f"4. {ALL[73].replace('the copyright holder', 'the Foo Group')}"],
    "Zlib": ["Copyright (C) 1995-2024 Jo Roe", f"{ALL[244]} {ALL[245]}", ALL[246], f"1. {ALL[247]} {ALL[248]} {ALL[249]}", f"2. {ALL[250]}", f"3. {ALL[251]}"],
    "BSL-1.0": [ALL[252], ALL[253], ALL[254], AS_IS],
    "Unlicense": [ALL[115], ALL[256], ALL[257], AS_IS],
    "ISC": ["Copyright (c) 2011, Jo Roe", ALL[113], f"{ALL[240]} {ALL[241]}"],
    "0BSD": ["Copyright (C) 2006 by Jo Roe", ALL[242], f"{ALL[240]} {ALL[241].replace('THE AUTHOR', 'JO ROE')}"],
    "MIT-0": ["MIT No Attribution", ALL[243], AS_IS],
    "WTFPL": [f"{ALL[258]}\nVersion 2, December 2004", ALL[259]],
    "Apache-2.0": ["Copyright 2020 Acme", "\n".join(ALL[i] for i in (21, 22)), ALL[23], ALL[24], ALL[25]],
    "LGPL-2.1": [f"This library is free software; {ALL[200]} {ALL[201]}", f"{ALL[42]} {ALL[43]}"],
}


def plain(text, signs):
    """Licences with a rule whose sentences all stand in the text, one behind the other: no cutting, no identifiers."""
    flat = normal(" ".join(line.strip().strip(signs) for line in text.split("\n")))
    found = set()
    for name, rule in every_rule():
        at = 0
        for i in rule:
            at = flat.find(normal(ALL[i]), at)
            if at < 0:
                break
        else:
            found.add(name)
    return found


def test_whole_texts_are_recognised(spark):
    rows, want = [], []
    for name, paragraphs in WHOLE.items():
        for sign in ("", "# ", " * ", "// ", ";; "):
            for width in (60, 76, 100_000):
                wrapped = "\n\n".join("\n".join(textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False)) for p in paragraphs for x in p.split("\n"))
                rows.append("\n".join((sign + line).rstrip() for line in f"some file\n\n{wrapped}\n\nint main".split("\n")))
                want.append({name})
    names = list(WHOLE)
    for a, b in zip(names, names[1:], strict=False):
        if {a, b} & {"BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD"} != {a, b}:
            rows.append("\n\n".join([*WHOLE[a], "and the other part:", *WHOLE[b]]))
            want.append({a, b})
    got = {r.doc_id: set(r.licenses.split(",")) for r in licences(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, (text, names_) in enumerate(zip(rows, want, strict=True)):
        assert got[i] == names_, (text, got[i], names_)
    # where no holder is named, the plain reading finds at least these
    for i, (text, names_) in enumerate(zip(rows, want, strict=True)):
        if names_ <= {"Zlib", "BSL-1.0", "Unlicense", "ISC", "MIT-0", "WTFPL", "LGPL-2.1"}:
            assert names_ <= plain(text, "#*/; "), text


def test_small_edits_and_long_texts(spark):
    mit = WHOLE["MIT"]
    texts = {
        1: "\n\n".join([*mit[:3], mit[4]]), 2: "\n\n".join([mit[2], "An added sentence of our own.", *mit[3:]]), 3: "\n\n".join(mit).replace('"AS IS"', "“AS IS”"),
        4: ("filler of a long text. " * 100_000) + "\n\n" + "\n\n".join(WHOLE["Zlib"]) + "\n\n" + "word " * 200_000, 5: "in no event shall " * 20_000, 6: "this software is provided by " * 20_000,
    }
    got = {r.doc_id: r.licenses for r in licences(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: "Zlib", 5: "", 6: ""}
    assert {i for _, r in RULES + MORE_RULES for i in r} <= set(ALL) and len({normal(s) for s in ALL.values()}) == len(ALL)

"""Macros, arguments and nested ranges at any depth, against hand-written rows and plain parsers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marklens.operators import markup, nesting, tokens


def _macros(spark, texts):
    df = spark.createDataFrame([(f"/f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    rows = markup.with_offsets(markup.arguments(markup.macros(df))).select("path", "pos", "name", "place", "oarg", "rarg", "rargs", "parts").collect()
    return [sorted(tuple(r)[1:] for r in rows if r.path == f"/f{i}") for i in range(len(texts))]


def test_hand_written_macros(spark):
    eight = "a{b{c{d{e{f{g{h}}}}}}}"
    texts = [
        "\\defi{a{b{c{d{e}}}}}", f"\\trefii[m?x]{{{eight}}}{{y}} z", "\\a[k={p,{q,{r,{s,t}}}},u]{v{w{x{y{z}}}}}", "\\a{{{{{\\b[o]{c}}}}}}", "\\a{b}}}\\c{d{e{f{g{h}}}}}",
        "\\a{{{{{x}}}}", "\\a [x]{y}", "\\symi{a}", "", "\\a[b][c]{{{{{d}}}}}", "\\verb|\\x{{{{{| \\y{1} % \\z{{{{{\n\\w{{{{{2}}}}}", "\\a[{x}{y}]{{{{{z}}}}}", "\\a*{{{{{q}}}}}{r}",
        "\\begin{module}[id=n]{y}[x]", "\\begin{module}[id=n]{y}[x]{{{{{",
    ]
    got = _macros(spark, texts)
    assert markup.LEVELS < 15  # braces behind a text send it the other way, and change none of its macros
    assert _macros(spark, [t + " " + "{" * 15 + "}" * 15 for t in texts]) == got
    assert got[0] == [(0, "defi", 0, "", "{a{b{c{d{e}}}}}", ["a{b{c{d{e}}}}"], [])]
    assert got[1] == [(0, "trefii", 0, "[m?x]", f"{{{eight}}}{{y}}", [eight, "y"], ["m?x"])]
    assert got[2] == [(0, "a", 0, "[k={p,{q,{r,{s,t}}}},u]", "{v{w{x{y{z}}}}}", ["v{w{x{y{z}}}}"], ["k={p,{q,{r,{s,t}}}}", "u"])]
    assert got[3] == [(0, "a", 0, "", "{{{{{\\b[o]{c}}}}}}", ["{{{{\\b[o]{c}}}}}"], []), (1, "b", 7, "[o]", "{c}", ["c"], ["o"])]
    assert got[4] == [(0, "a", 0, "", "{b}", ["b"], []), (1, "c", 7, "", "{d{e{f{g{h}}}}}", ["d{e{f{g{h}}}}"], [])]
    assert got[5] == [(0, "a", 0, "", "", [], [])]  # the first brace is never closed
    assert got[6] == [(0, "a", 0, "", "", [], [])]  # a space parts it from what follows
    assert got[7] == [(0, "symi", 0, "", "{a}", ["a"], [])] and got[8] == []
    assert got[9] == [(0, "a", 0, "[b,c]", "{{{{{d}}}}}", ["{{{{d}}}}"], ["b", "c"])]
    assert got[13] == got[14] == [(0, "begin", 0, "[id=n,x]", "{module}{y}", ["module", "y"], ["id=n", "x"])]
    assert [r[1] for r in got[10]] == ["y", "w"] or [r[1] for r in got[10]] == ["y"]
    assert got[11] == [(0, "a", 0, "[{x}{y}]", "{{{{{z}}}}}", ["{{{{z}}}}"], ["{x}{y}"])]
    assert got[12] == [(0, "a*", 0, "", "{{{{{q}}}}}{r}", ["{{{{q}}}}", "r"], [])]


def _plain(text):
    """Macros of a text by a walk with a stack."""
    pair, stack = {}, []
    for i, c in enumerate(text):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            pair[stack.pop()] = i
    out = []
    for m in re.finditer(r"\\([A-Za-z]+\*?)", text):
        at, opts, rargs = m.end(), [], []
        while True:
            if text[at : at + 1] == "{" and at in pair:
                rargs.append(text[at + 1 : pair[at]])
                at = pair[at] + 1
                continue
            z = at + 1
            while text[at : at + 1] == "[" and z < len(text) and text[z] not in "[]}" and not (text[z] == "{" and z not in pair):
                z = pair[z] + 1 if text[z] == "{" else z + 1
            if text[at : at + 1] == "[" and text[z : z + 1] == "]":
                opts.append(text[at + 1 : z])
                at = z + 1
                continue
            break
        out.append((len(out), m.group(1), m.start(), "[" + ",".join(opts) + "]" if opts else "", "".join(f"{{{r}}}" for r in rargs), rargs))
    return out


def test_random_texts(spark):
    rng = random.Random(2)
    balanced = lambda d: "".join(rng.choice(["a", "\\x", "\\yy*", ",", " "]) if d == 0 or rng.random() < 0.5 else rng.choice("{[{{") + balanced(d - 1) + "}" for _ in range(rng.randrange(1, 4)))
    fix = lambda t: "".join(rng.choice(["]"]) if c == "}" and o == "[" else c for c, o in _opened(t))
    texts = [fix(balanced(rng.randrange(1, 9))) for _ in range(150)] + ["".join(rng.choice("{{}}[]\\ab ") for _ in range(rng.randrange(40))) for _ in range(150)]
    got = _macros(spark, texts)
    for text, rows in zip(texts, got):
        want = _plain(text)
        # an optional argument with an unpaired brace inside is none; the two say so for texts whose braces pair
        if text.count("{") == text.count("}") and all(text[:i].count("{") >= text[:i].count("}") for i in range(len(text))):
            assert [r[:6] for r in rows] == want, text
        assert [r[:3] for r in rows] == [w[:3] for w in want], text


def _opened(text):
    """Each character with the opening sign that a closing brace belongs to."""
    stack = []
    for c in text:
        if c in "{[":
            stack.append(c)
        yield c, stack.pop() if c == "}" and stack else None


def test_swept_equals_read(spark):
    from marklens.plans.fixtures import Tables

    clean = Tables(spark, "/root/testdata/sf0.001").tex_sources().select("path", markup.mask_comments(markup.mask_verbatim(F.col("text"))).alias("clean"))
    clean = clean.filter(markup.brace_depth(F.col("clean")) <= markup.LEVELS)
    a, b = ({tuple(map(str, r)) for r in f(clean).select("path", "pos", "name", "oarg", "rarg", "rargs", "lead", "span").collect()} for f in (markup._read, markup.swept))
    assert a == b and len(a) > 2500


@pytest.mark.parametrize("half_open", [False, True])
def test_nearest_against_all_pairs(spark, half_open):
    rng, ranges, points = random.Random(8), [], []

    def fill(path, a, z, depth):
        while a + 1 < z and rng.random() < 0.7:
            b = rng.randrange(a, z)
            e = rng.randrange(b + 1, z + 1)
            if e < z and b > a:
                ranges.append((path, b, None if depth == 0 and rng.random() < 0.2 and all(r[0] != path for r in ranges) else e, f"{b}-{e}"))
                fill(path, b + 1, e - 1, depth + 1)
            a = e + 1

    for p in "abcdef":
        fill(p, 0, 60, 0)
        points += [(p, rng.randrange(62), i) for i in range(30)]
    closed = [(p, b, e if e is not None else None, n) for p, b, e, n in ranges if e is not None]
    df = spark.createDataFrame(closed, "path string, begin_pos long, end_pos long, name string")
    got = nesting.nearest(spark.createDataFrame(points, "path string, pos long, i int"), df, half_open).collect()
    inside = lambda r, p: r[0] == p[0] and (r[1] <= p[1] < r[2] if half_open else r[1] < p[1] < r[2])
    for r in got:
        own = [x for x in closed if inside(x, r)]
        assert (r.near and r.near.name) == (max(own, key=lambda x: x[1])[3] if own else None)
    assert len(got) == len(points) and sum(r.near is not None for r in got) > 20
    chain = {(r.path, r.begin_pos): r.names for r in nesting.chains(df, "name").collect()}
    for p, b, e, n in closed:
        assert chain[p, b] == [x[3] for x in sorted(closed, key=lambda x: x[1]) if x[0] == p and x[1] <= b and x[2] >= e]


def test_environments_and_stray_ends(spark):
    text = "\\end{x}\\begin{a}\\u\\begin{b}\\v\\end{b}\\end{a}\\end{y}\\w\\begin{c}\\z"
    args = markup.arguments(markup.macros(spark.createDataFrame([("/p", text)], "path string, text string")))
    envs = tokens.environments(args)
    assert sorted((r.env, r.begin_pos, r.end_pos, r.end_env, r.depth) for r in envs.collect()) == [("a", 1, 6, "a", 1), ("b", 3, 5, "b", 2), ("c", 9, None, None, 1)]
    got = {r.name: r.envs for r in tokens.enclosing(args.filter("length(name) = 1"), envs).collect()}
    assert got == {"u": ["a"], "v": ["a", "b"], "w": [], "z": ["c"]}


def test_one_large_file(spark):
    """A file of many thousand macros: a sort, not a product of macros and ranges."""
    n = 40_000
    text = "\\begin{m}" + "\\begin{a}\\x{{{{{1}}}}}\\end{a}" * n + "\\end{m}"
    args = markup.arguments(markup.macros(spark.createDataFrame([("/p", text)], "path string, text string")))
    got = nesting.nearest(args.filter("name = 'x'"), tokens.environments(args)).groupBy("near.env", "rarg").count().collect()
    assert [tuple(r) for r in got] == [("a", "{{{{{1}}}}}", n)]

"""Documented functions, splitting and generated files."""

import random
from datetime import datetime

import pytest

from hewn.llm import code, doc_pairs, handwritten, split

C = (
    "row_id long, id string, file_id long, rel_path string, start_line int, end_line int, kind string, language string, content string, docstring string, full_tokens int, func_name string"
)


def chunk(row, content, path="a/b.py", kind="function", doc=None, start=10, file=1, language=None):
    n = (content or "").count("\n")
    return (row, f"id{row}", file, path, start, start + n, kind, language, content, doc, 1, "clash")


DOC = "Merge two clusters that overlap into one."
PY = f'def merge(a, b):\n    """{DOC}"""\n    return a\n'
EXPECT = [
    (PY, "x.py", "function", None, ["merge"]),
    (PY.replace('"""', "'''"), "x.py", "function", None, ["merge"]),
    (f"# {DOC}\n@cached(\n    1,\n)\ndef merge(a):\n    return a\n", "x.py", "function", None, ["merge"]),
    (f"# {DOC}\n\ndef merge(a):\n    return a\n", "x.py", "function", None, []),
    (f"def merge(a):\n    # {DOC}\n    return a\n", "x.py", "function", None, []),
    (f'def merge(a):\n    x = 1\n    """{DOC}"""\n', "x.py", "function", None, []),
    (f'x = """\ndef inner():\n    "{DOC}"\n"""\ndef merge(a):\n    return a\n', "x.py", "unknown", None, []),
    ("def merge(a):\n    return a\n", "x.py", "function", DOC, ["merge"]),
    ("class A:\n    def merge(self):\n        return 1\n\n    def other(self):\n        return 2\n", "x.py", "class", DOC, []),
    ('def merge_two_parts(a):\n    """Function to merge the two parts."""\n    return a\n', "x.py", "function", None, []),
    ('def merge(a):\n    """TODO: write docs"""\n', "x.py", "function", None, []),
    ('def merge(a):\n    """返回剩余预算内能放下的片段。"""\n', "x.py", "function", None, ["merge"]),
    (f"/** {DOC} */\nexport const merge = async (a, b) => {{\n  return '}}';\n}};\n", "x.ts", "function", None, ["merge"]),
    (f"class A {{\n  /**\n   * {DOC}\n   * @param a left\n   */\n  static merge(a) {{\n    return `${{a}}`;\n  }}\n\n  b() {{\n    return 1;\n  }}\n}}\n", "x.js", "class", None, ["merge"]),
    (f"// {DOC}\nfunc (s *S) Merge(a int) int {{\n\treturn 1\n}}\n", "x.go", "method", None, ["Merge"]),
    (f'#[doc = "{DOC}"]\n#[inline]\npub fn merge<T>(a: &T) -> u8 {{\n    1\n}}\n', "x.rs", "function", None, ["merge"]),
    (f"/// {DOC}\n@Override\npublic static <T> List<T> merge(List<T> a) throws E {{\n    return a;\n}}\n", "X.java", "method", None, ["merge"]),
    ("// if (a > b) {\n//     return merge(a, b, c, d);\n// }\nfunction merge(a) {\n  return a;\n}\n", "x.js", "function", None, []),
    ('def load(path):\n    """Parses config files."""\n', "x.py", "function", None, ["load"]),
    ("/** Adds two matrices elementwise */\nexport const add = (a, b) => {\n  return a;\n};\n", "x.ts", "function", None, ["add"]),
    ('def user_id(a):\n    """Returns the user id."""\n', "x.py", "function", None, ["user_id"]),
    ('def user_id(a):\n    """The user id."""\n', "x.py", "function", None, []),
    ("# ----------\ndef merge(a):\n    return a\n", "x.py", "function", None, []),
    ("/*! digest v2.13.6 */\nfunction v(a) {\n  return a;\n}\n", "x.js", "function", None, []),
    (None, "x.py", "function", DOC, []),
    ("", "x.py", "function", DOC, []),
]


@pytest.mark.parametrize("content,path,kind,doc,want", EXPECT)
def test_documented(content, path, kind, doc, want):
    got = [n for n, t, _ in doc_pairs.documented(content, code.family(path, None), doc) if t] if content else []
    assert got == want


def test_comment_chunk_above_and_copies(spark):
    body = "def merge(a):\n    return a\n"
    rows = [
        chunk(1, f"# {DOC}", kind="Comment", start=9), chunk(2, body), chunk(3, body), chunk(4, f"# {DOC}", kind="comment", start=8, file=2), chunk(5, body, file=2), chunk(6, PY, file=3),
        chunk(7, "# x = merge(1)", kind="comment", start=9, file=4), chunk(8, body, file=4), chunk(9, None, file=5), chunk(10, body, file=None),
    ]
    df = spark.createDataFrame(rows, C)
    got = sorted((r.row_id, r.func_name) for r in doc_pairs.pairs(df, with_code=False).collect())
    assert got == [(2, "merge"), (3, "merge"), (6, "merge")]
    full = {r.row_id: (r.description, r.code) for r in doc_pairs.pairs(df).collect()}
    assert full[6] == (DOC, PY.rstrip("\n")) and full[2] == (DOC, body.rstrip("\n"))  # the function, not the chunk
    assert doc_pairs.pairs(spark.createDataFrame([], C)).count() == 0


def test_functions_in_variable_and_import_chunks_count(spark):
    arrow = f"/** {DOC} */\nexport const merge = (a, b) => {{\n  return a;\n}};\n"
    rows = [chunk(1, arrow, path="x.ts", kind="variable"), chunk(2, f"import os\n\n\n{PY}", kind="Import", file=2), chunk(3, "import os\n", kind="import", doc=DOC, file=3), chunk(4, "LIMIT = 3\n", kind="variable", doc=DOC, file=4)]
    got = sorted((r.row_id, r.func_name) for r in doc_pairs.pairs(spark.createDataFrame(rows, C)).collect())
    assert got == [(1, "merge"), (2, "merge")]


def test_note_above_gives_the_function_only_and_the_last_note_counts(spark):
    two = "def merge(a):\n    return a\n\n\ndef other(a):\n    return 1\n"
    rows = [(*chunk(1, "# An older note on merging parts.", kind="comment", start=9), 1), (*chunk(2, f"# {DOC}", kind="comment", start=9), 2), (*chunk(3, two), 3)]
    df = spark.createDataFrame([(*r[:-1], datetime(2024, 1, r[-1])) for r in rows], C + ", ingested_at timestamp")
    assert [(r.row_id, r.func_name, r.description, r.code) for r in doc_pairs.pairs(df).collect()] == [(3, "merge", DOC, "def merge(a):\n    return a")]


def test_decorator_of_many_lines():
    text = "import os\n\n\n@register(\n" + "".join(f"    option_{i}={i},\n" for i in range(40)) + ")\ndef first():\n    pass\n\n\ncall(\n    1,\n)\ndef second():\n    pass\n"
    assert split.member_lines("def zero():\n    pass\n\n\n" + text, "python", "unknown") == [7, 56]


def test_member_lines():
    text = "class A:\n    def a(self):\n        return '''\n    def no(self): pass\n'''\n\n    # note\n    @dec\n    def b(self):\n        def inner():\n            pass\n        return inner\n"
    assert split.member_lines(text, "python", "Class") == [6]
    text = "function a() {\n  return 1;\n}\n\n/** doc */\nexport const b = (x) => {\n  return x;\n};\n\nclass C {\n  m() {\n    return 1;\n  }\n}\n"
    assert split.member_lines(text, "js", "unknown") == [4, 9]
    assert split.member_lines(None, "js", "unknown") == [] and split.member_lines("var a=1;", "js", None) == []


@pytest.mark.parametrize("limit,overlap", [(40, 0), (60, 15), (400, 100)])
def test_pieces_cover_in_order_under_the_limit(limit, overlap):
    rnd = random.Random(limit)
    for n in range(40):
        text = "".join(rnd.choice(["def f():\n", "    x = 1\n", "\n", "y" * rnd.randrange(1, 90), "\r\n", " ", "é"]) for _ in range(60))
        for lang in ("python", None):
            p = split.split_item(text, lang, "unknown", limit, overlap)
            assert p[0][0] == 0 and p[-1][1] == len(text)
            assert all(0 < b - a <= limit for a, b, _ in p)
            assert all(q[2] == r[1] and q[2] - overlap <= q[0] <= q[2] for r, q in zip(p, p[1:]))
    assert split.split_item("", "python", None) == [] and split.split_item(None, "python", None) == []


def test_split_table(spark):
    long = "\n\n".join(f"def f{i}(a):\n    return {i}" + "\n    # pad" * 20 for i in range(60))
    df = spark.createDataFrame([chunk(1, long, kind="unknown", start=5), chunk(2, "short", kind=None), chunk(3, None), chunk(4, long, kind=None, path=None)], C)
    got = [r for r in split.split_chunks(df, 1000, 100).collect() if r.row_id == 1]
    assert all(len(r.piece_text) <= 1000 for r in got) and got[0].start_line == 5
    lines = long.split("\n")
    for r in got:
        assert r.piece_text.removesuffix("\n").split("\n") == lines[r.start_line - 5 : r.end_line - 4]
    want = [5 + i for i, x in enumerate(lines) if x.startswith("def ")][1:]
    assert [r.line_no for r in split.boundaries(df, 1000).filter("row_id = 1").orderBy("line_no").collect()] == want
    assert split.split_chunks(spark.createDataFrame([], C)).count() == 0


G = "row_id long, file_id long, path string"


def test_generated_files(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["merge", "cluster", "index", "total", "value", "window", "ledger"])

    def hand(i):
        return "\n".join(f"def {word()}_{word()}_{i}(a, {word()}):\n    # {word()} the {word()} of {word()}\n    {word()} = {word()}(a) + {rnd.randrange(9)}\n    return {word()}" for _ in range(6))

    def made(i):
        return "\n".join(f"def get_field_{k:04d}(m):\n    return m._f[{k}]\n" for k in range(30))

    rows, r = [], 0
    for i in range(120):
        tool = i % 4 == 0
        head = None if i % 8 == 4 else "# Code generated by x-gen 1.2. DO NOT EDIT." if tool else "# SPDX-License-Identifier: MIT"
        for c, k in ((head, "module_header"), (made(i) if tool else hand(i), "function")):
            if c:
                rows.append(chunk(r := r + 1, c, path=f"src/f{i}.py", kind=k, start=1 if k != "function" else 3, file=i))
    rows.append(chunk(r := r + 1, "# Vendored from foo 1.2 - send fixes upstream, not here.", path="src/v.py", kind="comment", start=1, file=500))
    rows.append(chunk(r := r + 1, None, path="src/vendor_portal/a.py", file=501))
    rows.append(chunk(r := r + 1, None, path=None, file=502))
    git = [(1, 600, "./src\\node_modules/x/y.js"), (2, 601, "src/min_dist/z.js"), (3, 602, "a/b.min.js"), (4, None, "q"), (5, 603, None)]
    out = handwritten.not_handwritten(spark.createDataFrame(rows, C), spark.createDataFrame(git, G)).collect()
    got = {x.file_id for x in out}
    assert got == {i for i in range(0, 120, 4)} | {500, 600, 602}
    empty = handwritten.not_handwritten(spark.createDataFrame([], C), spark.createDataFrame([], G))
    assert empty.count() == 0

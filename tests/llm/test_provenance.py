import random

import pytest

from lodeseam.llm import provenance as pv

HAND = 'import os\n\n\ndef load_chunk(path, size):\n    """Read a chunk of a file."""\n    with open(path) as f:\n        data = f.read(size)\n    return data\n\n\nclass Reader:\n    def __init__(self, root):\n        self.root = root\n\n    def names(self):\n        return sorted(os.listdir(self.root))\n'
WORDS = "amber basin cedar delta ember fjord grove heath islet jetty knoll ledge marsh notch oasis prong quarry ridge shoal tarn".split()
SHAPES = ["func {0}(a int) int {{", "\tif a > {1} {{ return a }}", "\tx := []int{{a, {1}}}", "\tfor a < {1} {{", "\t\ta += x[0] * {1}", "\t}}", "\tprintln(a, x)", "\treturn -a", "}}", ""]
TEMPLATES = [([f"Load{w.title()}" for w in WORDS * 2], "generated"), ([f"load_{w}" for w in WORDS], "generated"), (WORDS, None), ([f"{w}{v}" for w, v in zip(WORDS, ["Load", "Save"] * 10)], None), ([f"Load{w.title()}" for w in WORDS[:8]] + WORDS[8:], None)]


def shaped(names):
    return "package p\n" + "\n".join(line.format(n, i) for i, n in enumerate(names) for line in SHAPES)


RANDOM = random.Random(4)
MANGLED = "".join("function {0}({1}){{return {1}*3}};".format(*("".join(RANDOM.choices("bcdfghjklmnpqrstvwxz", k=RANDOM.randint(2, 12))) for _ in range(2))) for _ in range(60))
CASES = [
    ("src/a.py", HAND, None),
    ("vendor/lib/a.py", HAND, "vendored"),
    ("src/vendor_portal/a.py", HAND, None),
    ("gen/x/a.py", HAND, "generated"),
    ("src/a_pb2.py", HAND, "generated"),
    ("src/a.py", "# Code generated by toolgen. DO NOT EDIT.\n" + HAND, "generated"),
    ("src/a.py", HAND + "\n# @generated by toolgen from a.idl\n", "generated"),
    ("src/a.py", "# No longer generated: maintained by hand since then.\n" + HAND, None),
    ("src/a.py", HAND + '\nHEADER = "# Code generated by toolgen. DO NOT EDIT."\n' + HAND, None),
    ("src/a.py", "# Copyright (c) the maintainers of this repository.\n# Licensed under the terms in the LICENSE file at its root.\n" + HAND, None),
    ("src/a.js", "// Vendored from https://code.example/kit at tag v1.2.3, unmodified\nexport const x = 1;\n", "vendored"),
    ("src/a.js", "/*! kit v4.7.8 | (c) the kit contributors | MIT License */\nexport const x = 1;\n", "vendored"),
    ("src/a.py", "TABLE = [\n" + "    1, 22, 333, 4444, 55, 66, 777, 88, 9, 10,\n" * 60 + "]\n", "data"),
    ("src/a.js", "const q=1;" + "".join(f"function a{i}(b,c){{return b*{i}+c}};var d{i}=a{i}({i},2);" for i in range(200)), "minified"),
    ("src/b.js", MANGLED, "minified"),
    ("src/a.min.js", "x()", "minified"),
    ("src/a.py", "#!/usr/bin/env python\n" + "# A licence of many lines that says what may be done.\n" * 40 + "# Code generated by toolgen. DO NOT EDIT.\n" + HAND, "generated"),
    ("src/a.ts", "/*\n" + "A licence.\n" * 20 + "@generated by toolgen from a.idl\n*/\nexport const x = 1;\n", "generated"),
    ("src/a.py", '"""Loads chunks.\n\nAuto-generated by toolgen.\n"""\n' + HAND, "generated"),
    ("src/a.py", HAND + "\n# Skips what is @generated by toolgen from a.idl\n" + HAND, None),
    ("src/a.py", "# Copyright (c) the kit contributors.\n" + HAND, None),
    ("src/dump.sql", "INSERT INTO chunk VALUES (1, 'a');\n" * 40, None),
    ("docs/a.md", "plain words " * 200, None),
    ("src/empty.py", "", None),
    ("src/blank.py", " \n\n", None),
]


def table(spark):
    rows = [("r", f"{i}/{p}", t) for i, (p, t, _) in enumerate(CASES)] + [("hand", f"src/m{i}.py", HAND.replace("chunk", f"part{i}").replace("Reader", f"Loader{i}")) for i in range(30)]
    rows += [("hand", f"src/m{i}.js", f"export function loadPart{i}(pathName, chunkSize) {{\n  const dataLines = readLines(pathName);\n  return dataLines.slice(0, chunkSize);\n}}\n") for i in range(30)] + [("r", "src/null.py", None)]
    # a folder whose names are all in a style foreign to its repository and language, and one file alone in it
    rows += [("hand", f"src/port/m{i}.py", HAND.replace("load_chunk", f"loadChunk{i}").replace("Reader", f"rootReader{i}")) for i in range(4)] + [("hand", "src/one/m.py", HAND.replace("load_chunk", "loadChunk"))]
    rows += [("hand", f"src/w{i}.js", "".join(f"export function {WORDS[i % 20]}{w.title()}({w}Count) {{\n  return {w}Count + {i};\n}}\n\nconst {v}{w.title()} = {i};\n" for v, w in zip(RANDOM.sample(WORDS, 9), RANDOM.sample(WORDS, 9)))) for i in range(60)]
    rows += [("hand", f"src/t{j}.go", shaped(names)) for j, (names, _) in enumerate(TEMPLATES)] + [("hand", f"src/m{i}.go", shaped(RANDOM.sample(WORDS, 20))) for i in range(20)]
    return spark.createDataFrame(rows, "repo_id string, path string, text string").selectExpr("*", "1 as kind", "2 as lang")


@pytest.fixture(scope="module")
def found(spark):
    return {r.path: r.kind for r in pv.find(table(spark)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_kind(found, i):
    assert found.get(f"{i}/{CASES[i][0]}") == CASES[i][2]


def test_hand_written_stays(found):
    assert not [p for p in found if p.startswith("src/m")]


@pytest.mark.parametrize("i", range(len(TEMPLATES)))
def test_names_after_a_template(found, i):
    assert found.get(f"src/t{i}.go") == TEMPLATES[i][1]
    assert pv.traits(shaped(TEMPLATES[i][0]), None).template_share < pv.Limits().template_share


def test_foreign_style_of_a_folder(found):
    assert {p for p, k in found.items() if k == "vendored" and p.startswith("src/")} == {f"src/port/m{i}.py" for i in range(4)}


def test_the_model_decides(spark, found, monkeypatch):
    """Without what the model learnt, files that nothing else gives away stay hand-written."""
    monkeypatch.setattr(pv, "train", lambda files: {})
    without = {r.path: r.kind for r in pv.find(table(spark)).collect()}
    changed = {p for p in found if found[p] != without.get(p)}
    assert changed and all(CASES[int(p.split("/")[0])][1] == MANGLED for p in changed)


def test_empty(spark):
    assert pv.find(spark.createDataFrame([], "repo_id string, path string, text string")).count() == 0


def test_bits_tell_mangled_names_apart():
    import numpy as np

    words = ["load_chunk", "chunk_size", "load_file", "file_size", "read_chunk"] * 3
    counts = np.zeros(len(pv.ALPHABET) ** 3, np.float32)
    np.add.at(counts, pv.grams(words)[0], 1)
    known, odd = pv.bits_per_char(["read_file", "qxzvw"], counts)
    assert known < odd
    # a file's own names don't count for it
    np.add.at(counts, pv.grams(["qxzvw"])[0], 1)
    assert pv.bits_per_char(["read_file", "qxzvw"], counts)[1] == pytest.approx(odd, rel=0.05)

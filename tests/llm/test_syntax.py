import ast
import json
import tomllib

import pytest

from lodeseam.llm.glr import END, Grammar, Parser
from lodeseam.llm.syntax import check, first_error, rates

GOOD = {
    "python": ['x = [i for i in range(3) if i]\n', "async def f(a, /, b=1, *c, d, **e) -> int:\n    async with a as b:\n        yield\n", "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case A(b=2) | None: pass\n", "@d\nclass A(B, metaclass=C):\n    'doc'\n    def f(self): return lambda x, *y: x if y else {**z}\n", "f'{a!r:>{w}} {b[\"k\"]}'\n", "x: int = 3; y **= 2\nif (n := 10) > 5: pass\nelif a: pass\nelse: pass\n", "try:\n  pass\nexcept* E as e:\n  raise X from e\nfinally:\n  pass\n", "print(*a, **b)\ndel a[1:2, ::3], b.c\n", "\\\n\nx = (1,\n  2)\n", ""],
    "json": ['{"a": [1, -0.5e3, null, true, "\\u00e9"], "b": {}}', " [] ", '"x"'],
    "toml": ['a = 1\n[t.u]\nb = "x" # c\nc = [1,\n 2,\n]\n[[v]]\nd = {x = 1, y.z = 1979-05-27T07:32:00Z}\n', "", "'k' = '''a\nb'''\n"],
    "javascript": ["const f = async (a, {b, c = 1}, ...d) => ({a, b, [c]: d});\nexport default f", "for (const x of y) { if (/[/]\"'/.test(x)) continue; else z ??= `a${`b${1}`}c` }", "class A extends B { #p = 1; static async *g() { yield* x } get v() { return this?.#p } }", "let a = 1\nlet b = 2\nreturn\n", "import a, { b as c } from './x.js'\nexport * from 'y'\n", "x = a ? b : c, d\n;(function () {})()\n", "if (a) b\nelse c\ndo { } while (x)\nlabel: for (;;) { break label }"],
    "typescript": ["export type A<T> = { readonly [K in keyof T]?: T[K] } & B | (() => void);\n", "const f = <T,>(x: T): x is string => x as unknown as string;\n", "abstract class C<T> implements D { constructor(private readonly a: number, b?: string) { super() } abstract m(): Promise<Array<T>>; }", "interface I extends J { (x: number): string; y?: 'a' | 1; z(): void }\nenum E { A = 1, B }\n", "let x = f<number>(1)!;\nfunction g(this: any, a: number): asserts a is 1;\ndeclare module 'x' { export const y: typeof z }\n", "import type { A } from './a';\nexport type { A }\nconst q: Record<string, number> = { type: 1, yield: 2 };\n"],
    "go": ['package p\n\nimport (\n\t"fmt"\n\tx "y"\n)\n\ntype T[K comparable, V int | ~string] struct {\n\tA, B int `json:"a"`\n\t*C\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (d error) {\n\tfor i, v := range m {\n\t\tif x, ok := v.(int); ok && x > 1 {\n\t\t\tcontinue\n\t\t}\n\t\tgo func() { ch <- T{A: 1}.A }()\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tselect {\n\tcase <-ch:\n\t}\n\treturn &T{1, 2}, map[string][]int{"a": {1}}[k][1:2]\n}\n', "package q\n\nvar x = func(a int) func() { return nil }\nconst (\n\ta = iota\n\tb\n)\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@X(y = {1, 2}) public final class E<T extends F & G> extends H<T[]> implements I, J {\n private static final int[] k = {1, 2}, l[] = new int[3][];\n E(final int... a) throws Z { this(); }\n <U> List<? super U> m() { for (var x : y) { int z = (int) -x; q = (a, b) -> { return a; }; } try (R r = s()) { } catch (A | B e) { } finally { } return x -> y::new; }\n enum K { A { void f() {} }, B(1); }\n record P(int x, String y) { P { } }\n}\n", 'interface A { default void f() { String s = """\n  x "q"\n  """; switch (x) { case A, B -> 1; case C c when c.d() -> { } default -> throw e; }; int y = switch (z) { case 1: yield 2; default: yield 3; }; Object o = a instanceof B b && b.c() ? new D() { int e; } : f.<G>h(i)[j]++; } }'],
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = (1,\n", "print 'a'\n", "if a:\npass\n", "x = 'abc\n", "<<<<<<< HEAD\nx\n", "  x\n y\n", "f'{}'\n", "a = 5x\n", "import a b\n", "class A:\n", "if a:\n\tx\n        y\n", "x = )\n"],
    "json": ["", "{", '{"a": 1,}', "[1 2]", "{'a': 1}", "[01]", '{"a": NaN}', "// c\n{}", '"a\n"', "{} {}"],
    "toml": ["a = \n", "a 1\n", "[t\n", "a = 'x\n", "a = {b = 1,\n}\n", "= 1\n", "a = 01\n", "a = [1\n"],
    "javascript": ["function f( {", "const = 5;", "x = 'abc\n';", "a b", "if (x { }", "<<<<<<< HEAD\n", "let a = {b: 1", "return x +", "`abc", "class A { x y }", "for (x of) {}", "import from 'x'", "f(1, , 2)"],
    "typescript": ["type A = ;", "interface { }", "const x: = 1", "let a: Array<number = 1", "function f(a: number, { }", "enum { A }"],
    "go": ["package p\nfunc f( {\n}\n", "func f() {}\n", "package p\nvar x = \"a\n", "package p\nfunc f() { if x { }\n", "package p\nx := 1\n", "package p\nimport “fmt”\n", "package p\nfunc f() { return a b }\n"],
    "java": ["class A {", "class A { int x = ; }", "class A { void f() { x } }", "public void f() {} }", 'class A { String s = "a; }', "class A { void f() { if (x { } } }", "import a.b class C {}", "class A { char c = 'ab'; }"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_good(language, text):
    assert first_error(text, language) is None


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BAD.items() for t in v])
def test_bad(language, text):
    assert first_error(text, language) is not None


def test_line_of_first_error():
    assert first_error("x = 1\ny = (2\nz = ]\n", "python")[0] == 3


def test_against_the_parsers_of_the_standard_library(spark, sf):
    from lodeseam.llm.files import current_files

    tools = {"py": ("python", ast.parse), "json": ("json", json.loads), "toml": ("toml", tomllib.loads)}
    for r in current_files(spark.read.parquet(f"{sf}/chunks.parquet"), list(tools)).collect():
        language, parse = tools[r.path.rsplit(".", 1)[1]]
        try:
            parse(r.text)
            good = True
        except Exception:
            good = False
        assert (first_error(r.text, language) is None) == good, r.path


def test_ambiguous_grammar_is_recognized():
    g = Grammar("s: s s | 'a' | 's'? 'b' \n")

    def accepts(words):
        p = Parser(g)
        return all(p.feed("\0" + w) for w in words) and p.feed(END)

    assert accepts("aaaaaaaab") and accepts("sbab") and not accepts("") and not accepts("as")


def test_table(spark):
    rows = [("r", "a.py", "x = 1\n"), ("r", "b.py", "x = (\n"), ("r", "c.json", None), ("r", "d.py", ""), ("r", "e.md", "("), ("r", "f.PY", "x = ("), ("r", "g", "x"), ("s", "h.py", "y = [1] * 3\n" * 30_000)]
    df = spark.createDataFrame(rows, "repo_id string, path string, text string").selectExpr("*", "1 as language", "2 as parses")
    checked = check(df)
    assert {r.path for r in checked.filter("not parses").collect()} == {"b.py", "c.json", "f.PY"}
    got = {(r.repo_id, r.language): (r.files, r.invalid) for r in rates(checked).collect()}
    assert got == {("r", "python"): (4, 2), ("r", "json"): (1, 1), ("s", "python"): (1, 0)}
    assert check(df.limit(0)).count() == 0

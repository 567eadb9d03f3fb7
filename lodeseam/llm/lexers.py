"""Token streams of the languages that have a grammar here. A lexer yields (token, position); BAD marks what is no token."""

from __future__ import annotations

import re
from collections.abc import Iterator

BAD = "$bad"
Tokens = Iterator[tuple[str, int]]


def _master(*parts: tuple[str, str]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in parts), re.DOTALL)


def _words(text: str) -> dict[str, str]:
    return {w: "\0" + w for w in text.split()}


def _classes(**kinds: str) -> dict[str, str]:
    return {w: kind for kind, text in kinds.items() for w in text.split()}


# -- JSON --------------------------------------------------------------------------------------------------------------

_JSON = _master(
    ("space", r"[ \t\r\n]+"),
    ("STRING", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'),
    ("NUMBER", r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z_.])"),
    ("word", r"(?:true|false|null)\b"),
    ("punct", r"[{}\[\]:,]"),
    ("bad", r"."),
)


def json(text: str) -> Tokens:
    for m in _JSON.finditer(text):
        kind = m.lastgroup
        if kind == "space":
            continue
        yield ("\0" + m.group() if kind in ("word", "punct") else BAD if kind == "bad" else kind), m.start()


# -- TOML --------------------------------------------------------------------------------------------------------------

_BASIC = r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:["\\bfnrte]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}))*"'
_LITERAL = r"'[^'\x00-\x08\x0a-\x1f\x7f]*'"
_TOML_KEY = _master(("space", r"[ \t]+|\#[^\r\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*"), ("NEWLINE", r"\r?\n"), ("KEY", rf"[A-Za-z0-9_\-]+|{_BASIC}|{_LITERAL}"), ("open2", r"\[\["), ("close2", r"\]\]"), ("punct", r"[\[\].={},]"), ("bad", r"."))
_ML = r'"""(?:[^"\\]|\\(?:["\\bfnrte]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|"(?!"")|""(?!"))*"{3,5}'
_DATE = r"\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[+-]\d{2}:\d{2})?)?|\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
_NUM = r"[+-]?(?:inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?"
_TOML_VALUE = _master(
    ("space", r"[ \t]+|\#[^\r\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*"),
    ("NEWLINE", r"\r?\n"),
    ("VALUE", rf"{_ML}|'''(?:(?!''')[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f])*'{{3,5}}|(?!\"\"\"|'''){_BASIC}|(?!''')(?!\"\"\"){_LITERAL}|(?:true|false|{_DATE}|{_NUM})(?![A-Za-z0-9_.+\-:])"),
    ("punct", r"[\[\]{},]"),
    ("bad", r"."),
)


def toml(text: str) -> Tokens:
    at, value, header = 0, False, False
    stack: list[str] = []  # open brackets of values
    while at < len(text):
        m = (_TOML_VALUE if value else _TOML_KEY).match(text, at)
        kind, word, start = m.lastgroup, m.group(), at
        at = m.end()
        if kind == "space":
            continue
        if kind == "bad":
            yield BAD, start
        elif kind == "NEWLINE":
            if stack and stack[-1] == "[":
                continue
            if stack:
                yield BAD, start
            value = header = False
            yield "NEWLINE", start
        elif kind in ("KEY", "VALUE"):
            yield kind, start
        else:
            if value:
                if word in "[{":
                    stack.append(word)
                    value = word == "["
                elif word in "]}":
                    if not stack or stack.pop() != {"]": "[", "}": "{"}[word]:
                        yield BAD, start
                elif stack and stack[-1] == "{":
                    value = False
            elif word == "=":
                value = True
            elif word == "{" or (word == "}" and not (stack and stack.pop() == "{")):
                yield BAD, start
            elif word == "}":
                value = True
            yield "\0" + word, start
    if not text.endswith("\n"):
        yield "NEWLINE", at


# -- Python ------------------------------------------------------------------------------------------------------------

_PY_WORDS = _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type")
_PY_PUNCT = _classes(
    AUGMENTED="+= -= *= /= //= %= @= &= |= ^= >>= <<= **=",
    COMPARE="== != < > <= >=",
    BINARY="// % & ^ << >>",
) | _words("* ** + - / @ | ~ ( ) [ ] { } , : . ... ; = := ->")
_PY_STRING = re.compile(r"(?i:(?P<prefix>[bruft]{0,2}))(?P<quote>'''|\"\"\"|'|\")")
_PY_PREFIX = frozenset(["", "b", "r", "u", "f", "t", "br", "rb", "fr", "rf", "tr", "rt"])
_PY = _master(
    ("space", r"[ \t\f]+|\\\r?\n|\#[^\r\n]*"),
    ("newline", r"\r\n|\n|\r"),
    ("string", r"(?i:[bruft]{0,2})(?:\"|')"),
    ("NAME", r"[^\W\d]\w*"),
    ("NUMBER", r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:0(?:_?0)*|[1-9](?:_?[0-9])*)(?![0-9_.eEjJ])|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*\.(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|[jJ])))(?!\w)"),
    ("punct", r"\*\*=|//=|>>=|<<=|\.\.\.|!=|:=|->|[+\-*/%@&|^=<>]=|\*\*|//|<<|>>|[()\[\]{},:.;=+\-*/%@&|^~<>]"),
    ("bad", r"."),
)
_PY_BODY = {
    q: re.compile(r"(?:[^\\" + q[0] + ("" if len(q) == 3 else r"\r\n") + r"]|\\(?:\r\n|.)" + (rf"|{q[0]}(?!{q[0]}{q[0]})" if len(q) == 3 else "") + r")*" + q, re.DOTALL) for q in ("'", '"', "'''", '"""')
}
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _f_string(text: str, at: int, quote: str, raw: bool) -> int:
    """The end of an f-string whose body begins at `at`, -1 if it has none."""
    n = len(text)
    while at < n:
        c = text[at]
        if text.startswith(quote, at):
            return at + len(quote)
        if c == "\\":
            at += 2 if not (raw and text[at + 1 : at + 2] in "{}") else 1
        elif c == "{":
            if text.startswith("{{", at):
                at += 2
                continue
            at = _f_field(text, at + 1, quote, raw)
            if at < 0:
                return -1
        elif c == "}":
            if not text.startswith("}}", at):
                return -1
            at += 2
        elif c == "\n" and len(quote) == 1:
            return -1
        else:
            at += 1
    return -1


def _f_field(text: str, at: int, quote: str, raw: bool) -> int:
    """The place after the } that ends a replacement field whose expression begins at `at`."""
    depth, n, first = 0, len(text), at
    while at < n:
        c = text[at]
        if c in "([{":
            depth += 1
        elif c in ")]" or (c == "}" and depth):
            depth -= 1
            if depth < 0:
                return -1
        elif c == "}":
            return at + 1 if text[first:at].strip() else -1
        elif c in "'\"":
            m = _PY_STRING.match(text, at)
            end = _PY_BODY[m["quote"]].match(text, m.end())
            if not end:
                return -1
            at = end.end()
            continue
        elif c == ":" and not depth:
            at += 1
            while at < n and text[at] != "}":
                if text[at] == "{":
                    at = _f_field(text, at + 1, quote, raw)
                    if at < 0:
                        return -1
                elif text.startswith(quote, at) or (text[at] == "\n" and len(quote) == 1):
                    return -1
                else:
                    at += 1
            return at + 1 if at < n else -1
        elif c == "\n" and len(quote) == 1 and not depth:
            return -1
        at += 1
    return -1


def python(text: str) -> Tokens:
    at = 1 if text.startswith("﻿") else 0
    n = len(text)
    indents, alternative = [0], [0]
    brackets: list[str] = []
    fresh, content = True, False
    while at < n:
        if fresh and not brackets:
            column = alt = 0
            while at < n and text[at] in " \t\f":
                c = text[at]
                column, alt = (column + 1, alt + 1) if c == " " else ((column // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0)
                at += 1
            if at >= n:
                break
            if text[at] in "#\r\n":
                fresh = False
                content = False
            else:
                fresh, content = False, True
                if column > indents[-1]:
                    if alt <= alternative[-1]:
                        yield BAD, at
                    indents.append(column)
                    alternative.append(alt)
                    yield "INDENT", at
                else:
                    while column < indents[-1]:
                        indents.pop()
                        alternative.pop()
                        yield "DEDENT", at
                    if column != indents[-1] or alt != alternative[-1]:
                        yield BAD, at
        m = _PY.match(text, at)
        kind, word, start = m.lastgroup, m.group(), at
        at = m.end()
        if kind == "space":
            if word[0] == "\\":
                content = True
        elif kind == "newline":
            if not brackets:
                if content:
                    yield "NEWLINE", start
                fresh, content = True, False
        elif kind == "NAME":
            yield _PY_WORDS.get(word, "NAME"), start
        elif kind == "punct":
            if word in "([{":
                brackets.append(word)
            elif word in ")]}":
                if not brackets or brackets.pop() != _PAIRS[word]:
                    yield BAD, start
            yield _PY_PUNCT.get(word, BAD), start
        elif kind == "string":
            m = _PY_STRING.match(text, start)
            prefix, quote = m["prefix"].lower(), m["quote"]
            if len(quote) == 1 and text.startswith(quote * 2, m.end() - 1) is False and text[m.end() : m.end() + 1] == quote:
                at = m.end() + 1  # an empty string
            elif "f" in prefix or "t" in prefix:
                at = _f_string(text, m.end(), quote, "r" in prefix)
            else:
                body = _PY_BODY[quote].match(text, m.end())
                at = body.end() if body else -1
            if at < 0 or prefix not in _PY_PREFIX:
                yield BAD, start
                return
            yield "STRING", start
        else:
            yield (kind if kind == "NUMBER" else BAD), start
    if brackets:
        yield BAD, n
    if content:
        yield "NEWLINE", n
    for _ in indents[1:]:
        yield "DEDENT", n


# -- JavaScript, TypeScript --------------------------------------------------------------------------------------------

_JS_KEYWORDS = "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while yield null true false enum with let"
_JS_WORDS = _words(_JS_KEYWORDS) | _words("async get set static of as from accessor")
_TS_WORDS = _JS_WORDS | _words("public private protected readonly abstract override declare interface type namespace module is asserts keyof infer unique satisfies implements global out")
_JS_PUNCT = _classes(
    ASSIGN="+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=",
    BINARY="== != === !== <= >= && || ?? ** % << & | ^",
    UNARY="! ~",
    UPDATE="++ --",
) | _words("{ } ( ) [ ] ; , < > + - * / = => . ... ?. ? : @")
_TS_PUNCT = _JS_PUNCT | _words("& | !")
_JS_COMMON = (
    ("space", r"[ \t\f\v ﻿]+"),
    ("newline", r"\r\n|[\n\r  ]"),
    ("comment", r"//[^\n\r  ]*|/\*.*?\*/"),
    ("NAME", r"(?:[^\W\d]|[$_‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"),
    ("NUMBER", r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:0|[1-9](?:_?[0-9])*)n|(?:(?:0|[1-9](?:_?[0-9])*|0[0-9]+)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)(?![\w$])"),
    ("STRING", r"\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'"),
    ("PRIVATE", r"\#[^\W\d][\w$]*"),
    ("template", r"`"),
)
_JS_PUNCTUATION = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\*\*|<<|[+\-*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
_JS_DIVIDE = _master(*_JS_COMMON, ("punct", _JS_PUNCTUATION), ("bad", r"."))
_JS_REGEX = _master(*_JS_COMMON, ("REGEX", r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*"), ("punct", _JS_PUNCTUATION), ("bad", r"."))
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.DOTALL)
#: After these a slash divides.
_OPERANDS = frozenset(["NAME", "NUMBER", "STRING", "REGEX", "PRIVATE", "TEMPLATE", "TEMPLATE_TAIL", "UPDATE", *("\0" + w for w in ") ] } this super null true false async get set static of as from accessor".split())])
#: A line break after these ends the statement.
_RESTRICTED = frozenset("\0" + w for w in ("return", "break", "continue", "throw"))


def _ecma(text: str, words: dict[str, str], puncts: dict[str, str], soft: frozenset[str]) -> Iterator[tuple[str, int, bool]]:
    """(token, position, whether a line break stands before it)."""
    m = re.match(r"﻿?#![^\n]*", text)
    at = m.end() if m else 0
    previous, broken = "", False
    braces: list[bool] = []  # whether the brace belongs to a template
    n = len(text)
    while at < n:
        m = (_JS_DIVIDE if previous in _OPERANDS and not (previous == "\0}" and broken) else _JS_REGEX).match(text, at)
        kind, word, start = m.lastgroup, m.group(), at
        at = m.end()
        if kind == "space":
            continue
        if kind == "newline":
            broken = True
            continue
        if kind == "comment":
            broken |= "\n" in word
            continue
        if kind == "NAME":
            token = words.get(word, "NAME")
            if previous in ("\0.", "\0?.") and token != "NAME" and token not in soft:
                token = "KEYWORD"
        elif kind == "punct":
            token = puncts.get(word, BAD)
            if word == "{":
                braces.append(False)
            elif word == "}":
                if braces and braces.pop():
                    m = _TEMPLATE.match(text, at)
                    if not m:
                        yield BAD, start, broken
                        return
                    at = m.end()
                    token = "TEMPLATE_TAIL" if m[1] == "`" else "TEMPLATE_MIDDLE"
                    if m[1] != "`":
                        braces.append(True)
        elif kind == "template":
            m = _TEMPLATE.match(text, at)
            if not m:
                yield BAD, start, broken
                return
            at = m.end()
            token = "TEMPLATE" if m[1] == "`" else "TEMPLATE_HEAD"
            if m[1] != "`":
                braces.append(True)
        else:
            token = BAD if kind == "bad" else kind
        if broken and (previous in _RESTRICTED or token == "UPDATE") and previous not in ("\0;", "\0{", "\0}", "", "\0)"):
            yield "\0;", start, False
        yield token, start, broken
        previous, broken = token, False


_JS_SOFT = frozenset("\0" + w for w in "async get set static of as from accessor".split())
_TS_SOFT = frozenset(_TS_WORDS[w] for w in _TS_WORDS if w not in _JS_KEYWORDS.split())


def javascript(text: str) -> Iterator[tuple[str, int, bool]]:
    return _ecma(text, _JS_WORDS, _JS_PUNCT, _JS_SOFT)


def typescript(text: str) -> Iterator[tuple[str, int, bool]]:
    return _ecma(text, _TS_WORDS, _TS_PUNCT, _TS_SOFT)


# -- Go ----------------------------------------------------------------------------------------------------------------

_GO_WORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_GO_PUNCT = _classes(ASSIGN="+= -= *= /= %= &= |= ^= <<= >>= &^=", BINARY="&& || == != < <= > >= / % << >> &^", UNARY="!", INCDEC="++ --", SIGN="+ - ^ &") | _words("{ } ( ) [ ] ; , . ... : := = * | <- ~")
_GO = _master(
    ("space", r"[ \t\r]+|/\*[^\n]*?\*/|//[^\n]*"),
    ("newline", r"\n|/\*.*?\*/"),
    ("NAME", r"[^\W\d]\w*"),
    ("NUMBER", r"(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9]+)?)i?(?!\w)"),
    ("STRING", r'"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|`[^`]*`'),
    ("CHAR", r"'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"),
    ("punct", r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[+\-*/%&|^]=|<<|>>|&\^|[{}()\[\];,.:=+\-*/%&|^<>!~]"),
    ("bad", r"."),
)
_GO_ENDS = frozenset(["NAME", "NUMBER", "STRING", "CHAR", "INCDEC", *("\0" + w for w in ("break", "continue", "fallthrough", "return", ")", "]", "}"))])


def go(text: str) -> Tokens:
    previous = ""
    for m in _GO.finditer(text, 1 if text.startswith("﻿") else 0):
        kind = m.lastgroup
        if kind == "space":
            continue
        if kind == "newline":
            if previous in _GO_ENDS and "\n" in m.group():
                yield "\0;", m.start()
                previous = ";"
            continue
        word = m.group()
        token = _GO_WORDS.get(word, "NAME") if kind == "NAME" else _GO_PUNCT[word] if kind == "punct" else BAD if kind == "bad" else kind
        yield token, m.start()
        previous = token
    if previous in _GO_ENDS:
        yield "\0;", len(text)


# -- Java --------------------------------------------------------------------------------------------------------------

_JAVA_WORDS = (
    _words("abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface new package return static super switch synchronized this throw throws try void while true false null record sealed yield when module open to with requires exports opens uses provides permits")
    | _classes(MODIFIER="public protected private native strictfp transient volatile", PRIMITIVE="boolean byte char double float int long short")
    | {w: BAD for w in ("const", "goto", "_")}
)
_JAVA_PUNCT = _classes(ASSIGN="+= -= *= /= &= |= ^= %= <<= >>= >>>=", BINARY="&& || == != <= >= / ^ % <<", UNARY="! ~", UPDATE="++ --", SIGN="+ -") | _words("{ } ( ) [ ] ; , . ... : :: = -> ? < > & | @ *")
_JAVA = _master(
    ("space", r"[ \t\f\r\n\x1a]+|//[^\r\n]*|/\*.*?\*/"),
    ("dashed", r"non-sealed\b"),
    ("NAME", r"(?:[^\W\d]|\$)[\w$]*"),
    ("NUMBER", r"(?:0[xX](?:[0-9a-fA-F][0-9a-fA-F_]*)?(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+)?[lLfFdD]?|0[bB][01][01_]*[lL]?|(?:[0-9](?:[0-9_]*[0-9])?(?:\.(?:[0-9](?:[0-9_]*[0-9])?)?)?|\.[0-9](?:[0-9_]*[0-9])?)(?:[eE][+-]?[0-9]+)?[lLfFdD]?)(?![\w$])"),
    ("STRING", r'"""[ \t\f]*\r?\n(?:[^\\"]|\\.|"(?!""))*"""|"(?!"")(?:[^"\\\r\n]|\\(?:[btnfrs"\'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*"|""(?!")'),
    ("CHAR", r"'(?:[^'\\\r\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'"),
    ("punct", r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|[+\-*/&|^%]=|[{}()\[\];,.:=<>?!~+\-*/&|^%@]"),
    ("bad", r"."),
)


def java(text: str) -> Tokens:
    for m in _JAVA.finditer(text, 1 if text.startswith("﻿") else 0):
        kind = m.lastgroup
        if kind == "space":
            continue
        word = m.group()
        if kind == "NAME":
            yield _JAVA_WORDS.get(word, "NAME"), m.start()
        elif kind == "punct":
            yield _JAVA_PUNCT[word], m.start()
        else:
            yield ("\0non-sealed" if kind == "dashed" else BAD if kind == "bad" else kind), m.start()

"""Symbols and relations of one source text, by a token scanner with a table of rules per language.

No parser library is needed: a text becomes tokens, brackets are matched once, and one pass keeps a stack of
open declarations. Names inside a declaration are references, names before ``(`` calls. Limits, against a
full grammar: generic arguments between a callee and its ``(`` hide the call, and a call follows the
references of its receiver. Unknown and empty texts give no symbols.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_SLASH, _HASH, _DASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\#[^\n]*", r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*"
_QUOTED = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)'


def _words(x: str) -> frozenset[str]:
    return frozenset(x.split())


@dataclass(frozen=True)
class Rules:
    """What a language declares by keyword (keyword to kind), calls, imports and leaves out of references."""

    kinds: dict[str, str]
    keywords: frozenset[str]
    comment: str = _SLASH
    string: str = _QUOTED
    calls: bool = False
    methods: str | None = None  # kind of ``name(...) {`` in a class body
    modifiers: frozenset[str] = field(default_factory=frozenset)


#: Words that are no identifiers.
_C_WORDS = "if else for while do switch case default break continue return try catch finally throw new this super null true false void int long short byte char float double boolean class interface enum struct public private protected static final abstract const extends implements throws import package instanceof synchronized using namespace"
_JS = Rules(
    {"function": "Function", "class": "Class", "const": "Constant", "let": "Variable", "var": "Variable"},
    _words(_C_WORDS + " function let var of in typeof delete yield await async export from as undefined debugger get set type readonly number string any never unknown declare"),
    string=_QUOTED + r"|`(?:\\.|[^`\\])*`", calls=True, methods="Method", modifiers=_words("async abstract"),
)
RULES = {
    "javascript": _JS,
    "typescript": _JS,
    "python": Rules({"def": "Function", "class": "Class"}, _words("def class if elif else for while try except finally with as import from return yield lambda pass break continue raise global nonlocal assert del in is not and or async await True False None"), _HASH, _TRIPLE + "|" + _QUOTED, True, modifiers=_words("async")),
    "go": Rules({"func": "Function", "type": "Type"}, _words("func type struct interface map chan go defer select switch case default if else for range return break continue fallthrough goto var const import package nil true false iota"), string=_QUOTED + r"|`[^`]*`", calls=True),
    "rust": Rules(
        {"fn": "Function", "struct": "Type", "enum": "Type", "type": "Type", "trait": "Trait", "const": "Constant", "impl": "Type", "mod": "Module"},
        _words("fn struct enum type trait const impl mod pub use let mut ref if else match for while loop in return break continue move async await unsafe extern where as dyn static self crate super true false i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str"),
        string=r'r(?P<h>\#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]{1,9}?|[^\\\'\n])\'|\'\w+', calls=True, modifiers=_words("pub async unsafe const extern default"),
    ),
    "java": Rules({"class": "Class", "interface": "Interface", "enum": "Type"}, _words(_C_WORDS), methods="Function"),
    "csharp": Rules({"class": "Class", "interface": "Interface", "enum": "Type", "struct": "Type"}, _words(_C_WORDS + " string bool object var async await override virtual readonly internal sealed partial get set out ref in is as base foreach where"), calls=True, methods="Function"),
    "c": Rules({}, _words(_C_WORDS), calls=True),
    "cpp": Rules({}, _words(_C_WORDS), calls=True),
    "php": Rules({"function": "Function", "class": "Class", "interface": "Interface", "enum": "Type"}, _words(_C_WORDS + " function use echo array as foreach fn trait"), _SLASH + "|" + _HASH),
    "swift": Rules({"func": "Function", "class": "Class", "struct": "Class", "enum": "Class"}, _words(_C_WORDS + " func let var guard self nil in is as init deinit protocol extension where override")),
    "scala": Rules({"def": "Function", "class": "Class"}, _words(_C_WORDS + " def val var object trait extends with match case yield lazy override implicit sealed type"), calls=True),
    "dart": Rules({"class": "Class"}, _words(_C_WORDS + " var dynamic late required async await")),
    "lua": Rules({}, _words("function local if then else elseif end for while do repeat until return break nil true false and or not in"), _DASH, calls=True),
    "bash": Rules({"function": "Function"}, _words("if then else elif fi for while do done case esac in function return local export"), _HASH),
}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")
_GOES_ON = _words("= , + => && || ? : .")
_EXPRESSION = _words("= ( , : ? [ => && || ! return + - new . typeof")


class _Scan:
    def __init__(self, language: str, source: str):
        self.language, self.rules, self.source = language, RULES[language], source
        name = r"\$?[^\W\d]\w*" if language != "bash" else r"[^\W\d][\w-]*"
        scan = re.compile(rf"(?P<skip>{self.rules.comment})|(?P<str>{self.rules.string})|(?P<name>{name})|(?P<num>\d[\w.]*)|(?P<op>::|=>|->|&&|\|\||[^\s\w])", re.S)
        self.tokens = [(m.lastgroup if m.lastgroup else "str", m.group(), m.start(), m.end()) for m in scan.finditer(source) if m.group("skip") is None]
        self.kind = ["str" if self._is_string(t) else t[0] for t in self.tokens]
        self.text = [t[1] for t in self.tokens]
        self.lines = [0] + [m.end() for m in re.finditer("\n", source)]
        self.line = [bisect_right(self.lines, t[2]) for t in self.tokens]
        self.close = self._match()
        self.symbols: list[dict] = []
        self.relations: list[dict] = []

    @staticmethod
    def _is_string(t) -> bool:
        return t[0] not in ("name", "num", "op")

    def _match(self) -> dict[int, int]:
        out, stack = {}, []
        for i, x in enumerate(self.text):
            if self.kind[i] != "op":
                continue
            if x in _OPEN:
                stack.append(i)
            elif x in _CLOSE:
                while stack:
                    j = stack.pop()
                    out[j] = i
                    if _OPEN[self.text[j]] == x:
                        break
        last = len(self.text) - 1
        return out | {j: last for j in stack}

    def place(self, at: int) -> tuple[int, int]:
        """Line and byte column, from 1."""
        line = bisect_right(self.lines, at)
        return line, len(self.source[self.lines[line - 1] : at].encode()) + 1

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "name"

    def end(self, i: int, by_line: bool) -> tuple[int, int | None]:
        """Last token of a declaration from token ``i`` on, and its body's brace."""
        j = i
        while j < len(self.text):
            if self.kind[j] == "op":
                if self.text[j] == ";":
                    return j, None
                if self.text[j] == "{" and not (by_line and self.at(j - 1) in ("=", "(", ",")):
                    return self.close[j], j
                if self.text[j] in _CLOSE:
                    return j - 1, None
                if self.text[j] in _OPEN:
                    j = self.close[j]
            newline = j + 1 < len(self.text) and self.line[j + 1] > bisect_right(self.lines, self.tokens[j][3] - 1)
            if by_line and newline and self.text[j] not in _GOES_ON and self.at(j + 1) not in _GOES_ON - {","}:
                return j, None
            j += 1
        return len(self.text) - 1, None

    def indented(self, i: int) -> int:
        """Last token of a Python block whose header begins at token ``i``."""
        indent = self.tokens[i][2] - self.lines[self.line[i] - 1]
        j, header = i, True
        while j + 1 < len(self.text):
            k = j + 1
            if self.text[j] in _OPEN and self.kind[j] == "op":
                j = self.close[j]
                continue
            if self.text[j] == ":" and header:
                header = False
            first = self.line[k] > bisect_right(self.lines, self.tokens[j][3] - 1)
            if first and not header and self.tokens[k][2] - self.lines[self.line[k] - 1] <= indent:
                return j
            j = k
        return j

    def back(self, i: int) -> int:
        """First modifier before token ``i``."""
        while i > 0:
            if self.text[i - 1] in self.rules.modifiers or (self.kind[i - 1] == "str" and self.at(i - 2) == "extern"):
                i -= 1
            elif self.text[i - 1] == ")" and self.at(i - 4) == "pub":
                i -= 4
            else:
                break
        return i

    def statement(self, i: int) -> int:
        """First token after the bracket or semicolon before token ``i``."""
        while i > 0 and self.text[i - 1] not in (";", "{", "}"):
            i -= 1
        return i

    def declared(self, i: int, in_class: bool):
        """A declaration at token ``i``: (kind, name, start, name's tokens, end, body, where to go on), or None."""
        lang, word = self.language, self.text[i]
        kind = self.rules.kinds.get(word) if self.kind[i] == "name" else None
        js = self.rules is _JS
        if kind and lang == "python":
            return (kind, self.at(i + 1), self.back(i), (i + 1, i + 2), self.indented(i), None, i + 2) if self.named(i + 1) else None
        if kind and lang == "go":
            n = i + 1
            if word == "type":
                return None  # its specs are found by name
            if self.at(n) == "(":
                kind, n = "Method", self.close[n] + 1
            if not self.named(n):
                return None
            e, body = self.end(n, True)
            return kind, self.text[n], i, (n, n + 1), e, body, n + 1
        if lang == "go" and self.named(i) and word not in self.rules.keywords and (self.at(i - 1) == "type" or i in self.specs):
            e, body = self.end(i + 1, True)
            return "Interface" if self.at(i + 1) == "interface" else "Type", word, i, (i, i + 1), e, body, i + 1
        if kind and js and word in ("const", "let", "var"):
            if self.at(i - 1) == "for" or (self.at(i - 1) == "(" and any(t in ("of", "in") for t in self.text[i : self.close.get(i - 1, i)])) or self.at(i + 1) == "enum":
                return None
            n = i + 1
            stop = self.close[n] + 1 if self.at(n) in _OPEN else n + 1
            e, body = self.end(stop, True)
            if body is not None:
                e = e + 1 if self.at(e + 1) == ";" else e
            name = self.source[self.tokens[n][2] : self.tokens[stop - 1][3]] if n < len(self.text) else ""
            return (kind, name, i, (n, stop), e, None, stop) if name else None
        if kind and js and self.at(i - 1) in _EXPRESSION and word == "function":
            return None
        if kind and lang == "rust":
            if (word == "const" and (self.at(i - 1) == "*" or self.at(i + 2) != ":")) or self.at(i - 1) in ("->", ":", "&", "("):
                return None
            n, e_body = i + 1, self.end(i + 1, False)
            if word == "impl":
                if self.at(n) == "<":
                    deep = 0
                    while n < len(self.text):
                        deep += {"<": 1, ">": -1}.get(self.text[n], 0)
                        n += 1
                        if not deep:
                            break
                head = [j for j in range(n, e_body[1] or n) if self.text[j] in ("for", "where")]
                n = next((j + 1 for j in head if self.text[j] == "for"), n)
                stop = next((j for j in head if self.text[j] == "where" and j > n), e_body[1] or n)
                if stop <= n:
                    return None
                name = self.source[self.tokens[n][2] : self.tokens[stop - 1][3]]
                return kind, name.strip(), self.back(i), (n, stop), *e_body, i + 1
            if not self.named(n) or (word == "fn" and e_body[1] is None):
                return None
            return kind, self.text[n], self.back(i), (n, n + 1), *e_body, n + 1
        if kind and self.named(i + 1) and self.text[i + 1] not in self.rules.keywords:
            e, body = self.end(i + 2, lang in ("swift", "scala"))
            if word == "function" and lang == "php" and body is None and self.at(e) != ";":
                return None
            start = self.statement(i) if lang in ("java", "csharp") else self.back(i)
            return kind, self.text[i + 1], start, (i + 1, i + 2), e, body, i + 2
        if lang == "bash" and self.named(i) and self.at(i + 1) == "(" and self.at(i + 2) == ")" and self.at(i + 3) == "{":
            return "Function", word, i, (i, i + 1), self.close[i + 3], i + 3, i + 3
        if lang == "lua" and word == "function" and self.named(i + 1):
            n = i + 1
            while self.at(n) != "(" and n < len(self.text) and self.line[n] == self.line[i]:
                n += 1
            deep, j = 1, n
            while j + 1 < len(self.text) and deep:
                j += 1
                deep += 1 if self.text[j] in ("function", "if", "do", "repeat") else -1 if self.text[j] in ("end", "until") else 0
            start = i - 1 if self.at(i - 1) == "local" else i
            return "Function", self.source[self.tokens[i + 1][2] : self.tokens[n - 1][3]], start, (i + 1, n), j, None, n
        if self.rules.methods and in_class and self.named(i) and self.at(i + 1) == "(" and word not in self.rules.keywords - {"get", "set", "of", "from", "type", "delete"}:
            e, body = self.end(self.close[i + 1] + 1, False)
            before = self.at(i - 1)
            if js:
                good = body is not None and before not in (".", "new", "=", "(", "return")
            else:
                good = (self.named(i - 1) and before not in ("new", "return", "else", "throw") and (before not in self.rules.keywords or before in ("void", "int", "long", "short", "byte", "char", "float", "double", "boolean", "string", "bool", "object"))) or before in (">", "]")
            if good:
                start = i if js else self.statement(i)
                start = self.back(i) if js else start
                return self.rules.methods, word, start, (i, i + 1), e, body, i + 1
        return None

    def imported(self, i: int) -> tuple[str | None, int] | None:
        """Import at token ``i``: its target and the token to go on with."""
        lang, word = self.language, self.text[i]
        if self.kind[i] != "name" or word not in ("import", "from", "use"):
            return None
        if self.rules is _JS and word == "import" and self.at(i + 1) not in ("(", "."):
            j = i + 1
            while j < len(self.text) and self.kind[j] != "str" and self.text[j] != ";":
                j += 1
            return (self.text[j].strip("\"'`"), j + 1) if j < len(self.text) and self.kind[j] == "str" else None
        if lang == "python" and word in ("import", "from") and (i == 0 or self.line[i - 1] < self.line[i] or self.at(i - 1) in (";", ":")):
            j = i + 1
            while j < len(self.text) and self.text[j] != ";" and (self.line[j] == self.line[j - 1] or self.at(j - 1) == "\\"):
                j = self.close[j] + 1 if self.text[j] == "(" else j + 1
            parts = [x.strip(" \t\r\n()\\") for x in re.sub(r"#[^\n]*", "", self.source[self.tokens[i][3] : self.tokens[j - 1][3]]).replace(" import ", ",").replace(" import(", ",").split(",")]
            parts = [x for x in parts if x and x != "*"]
            return (parts[-1] if parts else None), j
        if lang == "rust" and word == "use":
            j = i + 1
            while j < len(self.text) and self.text[j] != ";":
                j += 1
            path, names = [], [k for k in range(i + 1, j) if self.kind[k] == "name"]
            for k in range(i + 1, j):
                if self.kind[k] != "name" and self.text[k] != "::" or self.text[k] == "as":
                    break
                path.append(self.text[k])
            target = "".join(path).rstrip(":").lstrip(":")
            if target in ("", "crate", "self", "super"):
                target = next((self.text[k] for k in names if self.text[k] not in self.rules.keywords), None)
            return target, j + 1
        if lang in ("java", "swift", "scala") and word == "import":
            j = i + 1
            while j < len(self.text) and self.line[j] == self.line[i] and self.text[j] != ";":
                j += 1
            whole = self.source[self.tokens[i][3] : self.tokens[j - 1][3]].strip().removeprefix("static ").removesuffix(".*")
            return (re.findall(r"\w+", whole) or [None])[-1] if lang == "scala" else whole or None, j
        return None

    def run(self) -> tuple[list[dict], list[dict]]:
        self.specs, bodies, stack, names = set(), set(), [], {}
        if self.language == "go":
            for i, x in enumerate(self.text):
                if x == "type" and self.at(i + 1) == "(":
                    j = i + 2
                    while j < self.close[i + 1]:
                        self.specs.add(j)
                        j = self.end(j + 1, True)[0] + 1
        open_braces: list[tuple[int, bool]] = []
        go_import, i = -1, 0
        while i < len(self.text):
            while stack and i > stack[-1][1]:
                stack.pop()
            while open_braces and i > open_braces[-1][0]:
                open_braces.pop()
            top = stack[-1][0] if stack else None
            x = self.text[i]
            if x == "{" and self.kind[i] == "op":
                literal = self.rules is _JS and self.at(i - 1) in ("=", "(", ",", ":", "return", "[")
                open_braces.append((self.close[i], i in bodies or literal))
            if self.language == "go" and x == "import" and self.kind[i] == "name":
                go_import = self.close[i + 1] if self.at(i + 1) == "(" else i + 2
            if i <= go_import:
                if self.kind[i] == "str":
                    self.relate("Import", top, x.strip("\"`"), i, "import")
                i += 1
                continue
            found = self.imported(i)
            if found:
                if found[0]:
                    self.relate("Import", top, found[0], i, "import")
                i = max(found[1], i + 1)
                continue
            d = self.declared(i, bool(open_braces) and open_braces[-1][1])
            if d:
                kind, name, start, own, end, body, go_on = d
                name = name.strip().strip("\"'`")
                line, column = self.place(self.tokens[start][2])
                local = f"{kind.lower()}:{name}:{line}:{column}"
                fq = f"{stack[-1][2]}::{name}" if stack else name
                last = self.place(self.tokens[max(end, start)][3])
                self.symbols.append({"local_id": local, "name": name, "fq_name": fq, "kind": kind, "parent_local_id": top, "start_line": line, "start_column": column, "end_line": last[0], "end_column": last[1]})
                stack.append((local, end, fq))
                names[own[0]] = own[1]
                if body is not None and kind in ("Class", "Interface", "Type"):
                    bodies.add(body)
                i = go_on
                continue
            if i in names:
                i = max(names[i], i + 1)
                continue
            if self.named(i) and x not in self.rules.keywords:
                j = i
                if self.language == "rust":
                    while self.at(j + 1) == "::" and self.named(j + 2):
                        j += 2
                if self.rules.calls and self.at(j + 1) == "(" and self.at(i - 1) != "new" and not (self.language == "go" and top and top.startswith("interface:")):
                    self.relate("Call", top, self.text[j], i, "call")
                if top:
                    self.relate("Reference", top, "".join(self.text[i : j + 1]), i, "identifier")
                i = j + 1
                continue
            i += 1
        return self.symbols, self.relations

    def relate(self, kind: str, source: str | None, target: str, i: int, reason: str) -> None:
        line, column = self.place(self.tokens[i][2])
        self.relations.append({"kind": kind, "source_local_id": source, "target_name": target, "reason": reason, "start_line": line, "start_column": column})


_extractors: dict = {}


def register_extractor(language: str, extract) -> None:
    """Use ``extract(source) -> (symbols, relations)`` for a language instead of the scanner; it must be
    picklable, since it goes to the executors."""
    _extractors[language] = extract


def extractors() -> dict:
    return dict(_extractors)


def extract(language: str | None, source: str | None, own: dict | None = None) -> tuple[list[dict], list[dict]]:
    """Symbols and relations in source order; none for null texts and languages without rules."""
    if own and language in own:
        return own[language](source or "")
    if language not in RULES or not source:
        return [], []
    return _Scan(language, source).run()

"""Static analysis of module texts: a lexer, and what is read off its tokens.

All functions are pure and work on one text, so they run in tasks next to the data
(`lodestone.operators.code` wraps them for DataFrames). Lines are numbered from 1.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from lodestone.ql import parser as ql

#: Managers of metadata in code, and the type of object they lead to.
MANAGERS = {
    "справочники": "Catalog", "документы": "Document", "перечисления": "Enum", "регистрысведений": "InformationRegister", "регистрынакопления": "AccumulationRegister",
    "регистрыбухгалтерии": "AccountingRegister", "регистрырасчета": "CalculationRegister", "планысчетов": "ChartOfAccounts", "планывидовхарактеристик": "ChartOfCharacteristicType",
    "планывидоврасчета": "ChartOfCalculationTypes", "планыобмена": "ExchangePlan", "обработки": "DataProcessor", "отчеты": "Report", "бизнеспроцессы": "BusinessProcess",
    "задачи": "Task", "константы": "Constant", "критерииотбора": "FilterCriterion", "хранилищанастроек": "SettingsStorage", "журналыдокументов": "DocumentJournal",
    "внешниеисточникиданных": "ExternalDataSource",
}
#: Words of the language that stand before a parenthesis without being calls.
LANGUAGE_WORDS = frozenset("""процедура функция конецпроцедуры конецфункции если тогда иначе иначеесли конецесли для пока цикл конеццикла каждого из по попытка
исключение конецпопытки возврат перем экспорт знач и или не выполнить новый новая""".split())
#: Global objects of the platform.
GLOBALS = frozenset("метаданные параметрысеанса библиотекакартинок webцвета символы библиотекастилей webшрифты глобальныепеременные".split())
#: Directives by where the code runs.
CLIENT = frozenset({"&наклиенте", "&наклиентенасервере", "&наклиентенасерверебезконтекста"})
SERVER = frozenset({"&насервере", "&насерверебезконтекста", "&наклиентенасервере", "&наклиентенасерверебезконтекста"})

NAME = r"[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё_0-9]*"
LEXER = re.compile(
    rf'(?P<literal>"(?:[^"\n]|""|\n[ \t\r]*\|)*(?P<closed>")?)|(?P<comment>//[^\n]*)|(?P<name>{NAME})|(?P<number>\d[\d.]*)|(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<mark>.)')
OPEN_WORDS, CLOSE_WORDS = frozenset({"процедура", "функция"}), frozenset({"конецпроцедуры", "конецфункции"})


class Lexeme(NamedTuple):
    kind: str
    text: str
    start: int
    line: int
    closed: bool = True

    @property
    def low(self) -> str:
        return self.text.lower()

    @property
    def value(self) -> str:
        """A literal's text: quotes undone, continuation bars gone."""
        inner = self.text[1:-1] if self.closed else self.text[1:]
        return re.sub(r"\n[ \t\r]*\|", "\n", inner).replace('""', '"')


def lexemes(text: str) -> list[Lexeme]:
    out, line = [], 1
    for m in LEXER.finditer(text):
        kind = m.lastgroup
        if kind == "line":
            out.append(Lexeme(kind, "\n", m.start(), line))
            line += 1
        elif kind in ("literal", "closed"):
            out.append(Lexeme("literal", m[0], m.start(), line, m["closed"] is not None))
            line += m[0].count("\n")
        else:
            out.append(Lexeme(kind, m[0], m.start(), line))
    return out


def masked(text: str, lexed: list[Lexeme] | None = None) -> str:
    """The text with literals and comments blanked; length and line ends stay."""
    return "".join(re.sub(r"[^\n]", " ", x.text) if x.kind in ("literal", "comment") else x.text for x in (lexemes(text) if lexed is None else lexed))


def literals(text: str) -> list[tuple[int, int, str]]:
    """(offset, line, value) of all literals that are closed; carriage returns removed."""
    out, line, at = [], 1, 0
    for m in LEXER.finditer(text):
        if m["closed"] is not None:
            line += text.count("\n", at, m.start())
            at = m.start()
            out.append((at, line, Lexeme("literal", m[0], at, line).value.replace("\r", "")))
    return out


# methods of a module


@dataclass
class Method:
    ord: int
    kind: str
    name: str
    signature: str
    is_export: bool
    directives: str
    description: str
    line_start: int
    line_end: int
    body: str


HEAD = re.compile(rf"\s*(процедура|функция)\s+([A-Za-zА-Яа-яЁё_0-9]+)\s*\(", re.I)
TAIL = re.compile(r"\s*конец(?:процедуры|функции)", re.I)
DIRECTIVE = re.compile(rf"\s*&{NAME}")


def _blocks(lines: list[str]) -> Iterator[tuple[int, int, int]]:
    """(first line, last line of the header, last line) of each method, as indices."""
    at = 0
    while at < len(lines):
        if not HEAD.match(lines[at]):
            at += 1
            continue
        header, depth = at, lines[at].count("(") - lines[at].count(")")
        while depth > 0 and header + 1 < len(lines):
            header += 1
            depth += lines[header].count("(") - lines[header].count(")")
        end, nested = header, 1
        while nested and end + 1 < len(lines):
            end += 1
            nested += 1 if HEAD.match(lines[end]) else -1 if TAIL.match(lines[end]) else 0
        yield at, header, end
        at = end + 1


def split_module(text: str) -> tuple[str, list[Method]]:
    """The module without the methods' code (declarations stay), and its methods."""
    lines = (text or "").splitlines()
    methods, rest, after = [], [], 0
    for n, (first, header, last) in enumerate(_blocks(lines)):
        rest += lines[after : header + 1]
        above = first - 1
        notes: list[str] = []
        while above >= after and (DIRECTIVE.match(lines[above]) or lines[above].lstrip().startswith("//")):
            if not DIRECTIVE.match(lines[above]):
                notes.append(lines[above])
            elif notes:
                break
            above -= 1
        directives, back = [], first - 1
        while back >= after and (DIRECTIVE.match(lines[back]) or not lines[back].strip() or lines[back].lstrip().startswith("//")):
            if DIRECTIVE.match(lines[back]):
                directives.append(lines[back].strip())
            back -= 1
        m = HEAD.match(lines[first])
        whole = " ".join(lines[first : header + 1])[m.end() :] if header > first else lines[first][m.end() :]
        inside, paren, behind = whole.rpartition(")")
        methods.append(Method(n, m[1].lower(), m[2], " ".join((inside if paren else behind).split()), bool(paren and re.search("экспорт", behind, re.I)),
                              ", ".join(reversed(directives)), "\n".join(reversed(notes)), first + 1, last + 1, "\n".join(lines[first : last + 1])))
        after = last + 1
    return "\n".join(rest + lines[after:]), methods


def parameters(signature: str) -> list[tuple[str, str | None, bool]]:
    """(name, default, by value) of each parameter; commas in literals and brackets do not separate."""
    parts, depth = [[]], 0
    for x in lexemes(signature or ""):
        depth += (x.text in "([") - (x.text in ")]") if x.kind == "mark" else 0
        if x.text == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(x.text)
    out = []
    for p in parts:
        name, equals, default = "".join(p).strip().partition("=")
        bare = re.sub(r"(?i)^знач\s+", "", name.strip())
        if bare:
            out.append((bare.strip(), default.strip() if equals else None, bare != name.strip()))
    return out


# conditions, names and calls

PREPROCESSOR = re.compile(r"\s*#\s*(если|иначеесли|иначе|конецесли|if|elsif|elseif|else|endif)\b\s*(.*)", re.I)
ENTER = {"тогда": "Если", "then": "Если", "цикл": "Цикл", "do": "Цикл", "попытка": "Попытка", "try": "Попытка"}
LEAVE = {"конецесли": "Если", "endif": "Если", "конеццикла": "Цикл", "enddo": "Цикл", "конецпопытки": "Попытка", "endtry": "Попытка"}


def conditions(text: str, lexed: list[Lexeme] | None = None) -> list[list[str]]:
    """For each line what surrounds it, as it is before the line: preprocessor, then blocks."""
    directives: list[str] = []
    blocks: list[tuple[str, int]] = []
    out = []
    for n, line in enumerate(masked(text, lexed).split("\n"), 1):
        out.append(directives + [f"блок {kind} (строка {at})" for kind, at in blocks])
        if m := PREPROCESSOR.match(line):
            word = m[1].lower()
            if word not in ("если", "if") and directives:
                directives = directives[:-1]
            if word in ("если", "if"):
                directives = [*directives, f"#Если {m[2].strip()} (строка {n})"]
            elif word in ("иначеесли", "elsif", "elseif"):
                directives = [*directives, f"#ИначеЕсли {m[2].strip()} (строка {n})"]
            elif word in ("иначе", "else"):
                directives = [*directives, f"#Иначе (строка {n})"]
            continue
        words = [w.lower() for w in re.findall(NAME, line)]
        blocks += [(ENTER[w], n) for w in words if w in ENTER]
        for w in words:
            if w in LEAVE:
                at = max((i for i, b in enumerate(blocks) if b[0] == LEAVE[w]), default=None)
                if at is not None:
                    blocks = blocks[:at] + blocks[at + 1 :]
    return out


def _code(text: str, lexed: list[Lexeme] | None = None) -> list[Lexeme]:
    return [x for x in (lexemes(text) if lexed is None else lexed) if x.kind not in ("space", "line", "comment")]


def local_names(text: str, params: list[str] = ()) -> set[str]:
    """Variables and parameters, in lower case: what stands before a dot need not be a module."""
    names = {p.lower() for p in params}
    code = _code(text)
    for i, x in enumerate(code):
        before, after = code[i - 1] if i else None, code[i + 1] if i + 1 < len(code) else None
        if x.kind == "name" and after is not None and after.text == "=" and (before is None or before.text in ";(," or before.line < x.line or before.low in ("тогда", "цикл", "для")):
            names.add(x.low)
        if x.low == "каждого" and after is not None:
            names.add(after.low)
        if x.low == "перем":
            j = i + 1
            while j < len(code) and (code[j].kind == "name" or code[j].text == ","):
                if code[j].kind == "name" and code[j].low != "экспорт":
                    names.add(code[j].low)
                j += 1
    for _, _, signature in _declared(text):
        names |= {n.lower() for n, _, _ in parameters(signature)}
    return names


def _declared(text: str):
    for m in re.finditer(rf"\b(процедура|функция)\s+({NAME})\s*\(([^()]*)\)", masked(text), re.I):
        yield m[1], m[2], m[3]


@dataclass(frozen=True)
class Call:
    line: int
    form: str  # dotted, plain, string
    left: str | None
    name: str
    conditions: tuple[str, ...] = ()


def calls(text: str) -> list[Call]:
    """All calls: Left.Name(, Name( and Вычислить/Выполнить of a literal that names a method."""
    lexed = lexemes(text)
    code, around = _code(text, lexed), conditions(text, lexed)
    state = lambda x: tuple(around[x.line - 1]) if x.line <= len(around) else ()
    out = []
    for i, x in enumerate(code):
        if x.kind != "name" or i + 1 >= len(code) or code[i + 1].text != "(":
            continue
        before = code[i - 1] if i else None
        if before is not None and before.low in OPEN_WORDS:
            continue
        if x.low in ("вычислить", "выполнить") and (before is None or before.text != ".") and i + 2 < len(code) and code[i + 2].kind == "literal":
            target = code[i + 2].value.strip()
            if re.fullmatch(rf"{NAME}(?:\.{NAME})*", target):
                left, _, name = target.rpartition(".")
                out.append(Call(x.line, "string", left or None, name, state(x)))
                continue
        if before is not None and before.text == "." and i >= 2 and code[i - 2].kind == "name":
            chained = i >= 3 and code[i - 3].text == "."
            out.append(Call(x.line, "dotted", ("." if chained else "") + code[i - 2].text, x.text, state(x)))
        elif (before is None or before.text != ".") and x.low not in LANGUAGE_WORDS:
            out.append(Call(x.line, "plain", None, x.text, state(x)))
    return out


def call_sites(text: str, name: str) -> list[Call]:
    """The calls of one method, by line."""
    return sorted((c for c in calls(text) if c.name.lower() == name.lower()), key=lambda c: c.line)


def metadata_uses(text: str) -> list[tuple[int, str, str]]:
    """(line, type, name) of uses of metadata managers."""
    code = _code(text)
    return [(x.line, MANAGERS[x.low], code[i + 2].text) for i, x in enumerate(code[:-2])
            if x.kind == "name" and x.low in MANAGERS and code[i + 1].text == "." and code[i + 2].kind == "name" and (not i or code[i - 1].text != ".")]


def uses(text: str, params: list[str] = (), own: str | None = None) -> list[tuple[str, int, str | None, str]]:
    """(kind, line, left, name) of what a method's code names beyond itself, each once, by first line.

    Kinds: call (Left.Name, where Left is no variable, manager or platform object), plain
    (Name), dynamic (a name in a literal that is evaluated) and metadata (left: the type)."""
    known = local_names(text, list(params)) | ({own.lower()} if own else set())
    found = []
    for c in calls(text):
        left = (c.left or "").lower()
        if c.form == "string":
            found.append(("dynamic", c.line, c.left, c.name))
        elif c.form == "plain" and c.name.lower() not in known:
            found.append(("plain", c.line, None, c.name))
        elif c.form == "dotted" and not left.startswith(".") and left not in known and left not in MANAGERS and left not in GLOBALS:
            found.append(("call", c.line, c.left, c.name))
    managers = {kind: manager for manager, kind in MANAGERS.items()}
    found += [("metadata", line, kind, name) for line, kind, name in metadata_uses(text) if managers[kind] not in known]
    first: dict[tuple, tuple] = {}
    for row in sorted(found, key=lambda r: r[1]):
        first.setdefault((row[0], (row[2] or "").lower(), row[3].lower()), row)
    return list(first.values())


# queries in literals

QUERY_HEAD, QUERY_SOURCE = re.compile(r"\s*(?:выбрать|выразить|select)\b", re.I), re.compile(r"\b(?:из|from)\b", re.I)


def embedded_queries(text: str) -> list[tuple[int, str, bool]]:
    """(line, text, complete) of query texts. Literals joined by + are one text; a text that
    ends in + is not complete, nor is one without a source."""
    out, group, joined = [], [], False
    for x in [*_code(text), None]:
        if x is not None and x.kind == "literal" and (not group or joined):
            group.append(x)
            joined = True
        elif x is not None and x.text == "+" and group:
            joined = "plus"
        else:
            if group:
                query = "\n".join(g.value for g in group)
                if QUERY_HEAD.match(query):
                    out.append((group[0].line, query, bool(QUERY_SOURCE.search(query)) and joined != "plus"))
            group, joined = ([x], True) if x is not None and x.kind == "literal" else ([], False)
        if x is not None and x.kind == "literal" and group and group[-1] is x:
            joined = True
    return out


def query_columns(query: str) -> list[str]:
    """The result columns of a query text; none if it does not parse."""
    try:
        statements = ql.parse(query)
    except ql.SyntaxProblem:
        return []
    out = []
    for s in (n for n in ql.walk(statements) if isinstance(n, ql.Select)):
        for i in s.items:
            out.append(i.alias or ("*" if isinstance(i.value, ql.Star) else i.value.parts[-1] if isinstance(i.value, ql.Field) else "<выражение>"))
    return out


def result_schema(text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of the columns that a method seems to build, each once."""
    found, code = [], _code(text)
    for i, x in enumerate(code):
        if x.low == "добавить" and i >= 2 and code[i - 1].text == "." and code[i - 2].low == "колонки" and i + 2 < len(code) and code[i + 1].text == "(":
            arg = code[i + 2]
            found.append(("column", arg.value, x.line) if arg.kind == "literal" else ("column from variable", arg.text, x.line))
        if x.low == "структура" and i and code[i - 1].low in ("новый", "новая") and i + 2 < len(code) and code[i + 1].text == "(" and code[i + 2].kind == "literal":
            found += [("key", k.strip(), x.line) for k in code[i + 2].value.split(",") if k.strip()]
    for line, query, complete in embedded_queries(text):
        found += [("query column", n, line) for n in (query_columns(query) if complete else ())]
    return list({(k, n.lower()): (k, n, line) for k, n, line in reversed(found)}.values())[::-1]


# comparison


def normal_lines(text: str) -> list[str | None]:
    """Lines without comments and without white space outside of literals; None for empty ones."""
    out = [""]
    for x in lexemes(text):
        if x.kind == "line":
            out.append("")
        elif x.kind == "literal":
            first, *more = x.text.split("\n")
            out[-1] += first
            out += more
        elif x.kind not in ("space", "comment"):
            out[-1] += x.text
    return [line or None for line in out]


def compare_methods(left: Method, right: Method, context: int = 3) -> dict:
    """Which aspects of a method changed, and a unified diff of the normal forms' lines."""
    a, b = parameters(left.signature), parameters(right.signature)
    names_a, names_b = [p[0].lower() for p in a], [p[0].lower() for p in b]
    default_a, default_b = {p[0].lower(): p[1:] for p in a}, {p[0].lower(): p[1:] for p in b}
    both = [n for n in names_a if n in default_b]
    body = lambda m: [x for x in normal_lines(m.body) if x]
    changed = {
        "params_added": [n for n in names_b if n not in default_a], "params_removed": [n for n in names_a if n not in default_b],
        "defaults_changed": [n for n in both if default_a[n] != default_b[n]], "order_changed": both != [n for n in names_b if n in default_a],
        "export_changed": left.is_export != right.is_export, "directives_changed": left.directives.lower() != right.directives.lower(),
        "kind_changed": left.kind != right.kind, "body_changed": body(left)[1:] != body(right)[1:], "comments_changed": left.description != right.description,
    }
    identical = left.body == right.body and not any(changed.values())
    diff = list(difflib.unified_diff(left.body.splitlines(), right.body.splitlines(), "left", "right", lineterm="", n=context)) if changed["body_changed"] else []
    return changed | {"identical": identical, "formatting_only": not identical and not any(changed.values()), "diff": diff}


INTERCEPT = re.compile(r'&(Перед|После|Вместо|ИзменениеИКонтроль)\s*\(\s*"([^"]+)"\s*\)', re.I)


def intercepts(directives: str) -> list[tuple[str, str]]:
    """(how, method) of the interception directives of an extension's method."""
    return [(m[1], m[2]) for m in INTERCEPT.finditer(directives or "")]


@dataclass
class Lines:
    """Line and column of offsets in a text."""

    starts: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> "Lines":
        return cls([0, *(m.end() for m in re.finditer("\n", text))])

    def __call__(self, offset: int) -> tuple[int, int]:
        """0-based (line, column)."""
        line = bisect.bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]

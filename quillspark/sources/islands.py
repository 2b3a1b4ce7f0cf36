"""Declarations, imports and syntax errors of source files in languages with brackets, without a grammar of each.

A lexer tells words, strings, comments and brackets apart; brackets become a tree; and only islands are read: the heads of
declarations and import statements. Between them nothing needs to be understood, so a keyword in a string or a comment
is never seen. A per-row helper that runs inside tasks; its time is linear in the text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_CLOSE = {"(": ")", "[": "]", "{": "}"}
_WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
#: Lexical rules by language: what begins a comment to the end of a line, quotes with escapes, quotes without, templates.
_RULES = {
    "go": ("//", "\"'", "`", ""),
    "javascript": ("//", "\"'", "", "`"),
    "typescript": ("//", "\"'", "", "`"),
    "shell": ("#", '"', "'", ""),
    "ruby": ("#", "\"'", "", ""),
}
#: Words whose next name is declared, in languages without rules of their own.
_HEADS = {"func", "function", "class", "type", "struct", "interface", "fn", "def", "trait", "enum", "module"}


@dataclass
class Token:
    kind: str  # word, string, number, punct, open
    text: str
    start: int
    end: int
    first: bool = False  # of its line
    inside: list[Token] = field(default_factory=list)  # of an open bracket


@dataclass
class Found:
    """Symbols (kind, name, qualified name, start, end), imports (kind, start, end) and errors (message, start, end)."""

    symbols: list[tuple[str, str, str, int, int]] = field(default_factory=list)
    imports: list[tuple[str, int, int]] = field(default_factory=list)
    errors: list[tuple[str, int, int]] = field(default_factory=list)


def _lexer(language: str) -> re.Pattern:
    line, quoted, raw, template = _RULES.get(language, ("//", "\"'", "", ""))
    parts = [rf"(?P<comment>{re.escape(line)}[^\n]*" + (r"|/\*[\s\S]*?\*/" if line == "//" else "") + ")"]
    if line == "//":
        parts.append(r"(?P<open_comment>/\*)")
    strings = [rf"{q}(?:[^{q}\\\n]|\\[\s\S])*{q}" for q in quoted] + [f"{q}[^{q}]*{q}" for q in raw]
    parts.append(f"(?P<string>{'|'.join(strings)})")
    parts.append(rf"(?P<template>[{template or '\x00'}])")
    parts.append(f"(?P<open_string>[{quoted}{raw}])")
    parts += [rf"(?P<word>{_WORD})", r"(?P<number>[0-9][\w.]*)", r"(?P<open>[(\[{])", r"(?P<close>[)\]}])", r"(?P<line>\n)", r"(?P<punct>\.\.\.|=>|:=|[^\s])"]
    return re.compile("|".join(parts))


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_LEXERS: dict[str, re.Pattern] = {}


def tree(text: str, language: str) -> tuple[list[Token], list[tuple[str, int, int]]]:
    """The tokens of a text, those inside brackets under them, and what is wrong with strings, comments and brackets."""
    lexer = _LEXERS.setdefault(language, _lexer(language))
    top: list[Token] = []
    stack: list[tuple[Token | None, list[Token]]] = [(None, top)]
    errors: list[tuple[str, int, int]] = []
    templates: list[int] = []  # depths of the brackets that open ${ inside a template
    i, first, last = 0, True, None

    def template(at: int) -> int:
        """Goes on in a template's text: to its end, or into ${."""
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                opened = Token("open", "{", at + 1, at + 2)
                stack[-1][1].append(opened)
                stack.append((opened, opened.inside))
                templates.append(len(stack))
                return at + 2
            else:
                at += 1
        errors.append(("a string does not end", at - 1, at))
        return at

    while m := lexer.search(text, i):
        kind, i = m.lastgroup, m.end()
        if kind == "line":
            first = True
            continue
        if kind == "comment":
            continue
        if kind == "punct" and m[0] == "/" and language in ("javascript", "typescript") and (last is None or last.kind == "punct" or last.kind == "open" and not last.end or last.text in ("return", "typeof", "case")) and (r := _REGEX.match(text, m.start())):
            kind, i = "string", r.end()
        if kind in ("open_comment", "open_string"):
            errors.append((f"a {kind[5:]} does not end", m.start(), len(text) if kind == "open_comment" else (text.find("\n", i) + 1 or len(text))))
            i = len(text) if kind == "open_comment" else i
            continue
        if kind == "close":
            if len(stack) > 1 and _CLOSE[stack[-1][0].text] == m[0]:
                own, _ = stack.pop()
                own.end = i
                if templates and templates[-1] == len(stack) + 1:
                    templates.pop()
                    i = template(i)
            else:
                errors.append((f"{m[0]} closes nothing", m.start(), i))
            last, first = Token("word", m[0], m.start(), i), False
            continue
        token = Token("string" if kind == "template" else kind, text[m.start() : i], m.start(), i, first)
        stack[-1][1].append(token)
        first = False
        if kind == "open":
            token.end = 0
            stack.append((token, token.inside))
        elif kind == "template":
            i = template(i)
        last = token
    for own, _ in stack[1:]:
        own.end = len(text)
        errors.append((f"{own.text} is not closed", own.start, own.start + 1))
    return top, errors


def _statement_end(tokens: list[Token], k: int) -> int:
    """The index after the last token of a statement without a body: at a semicolon, or before a line of its own."""
    j = k + 1
    while j < len(tokens) and tokens[j].text != ";":
        if tokens[j].first and tokens[j - 1].text not in (",", "from", "import", "="):
            break
        j += 1
    return j


def _body(tokens: list[Token], k: int) -> Token | None:
    """The braces that end a head whose name is at ``k``."""
    for j in range(k, len(tokens)):
        if tokens[j].text == "{" and tokens[j].kind == "open":
            return tokens[j]
        if tokens[j].text == ";" or j > k and tokens[j].first and tokens[j].kind == "word":
            return None
    return None


def _is(tokens: list[Token], k: int, *texts: str) -> bool:
    return k < len(tokens) and tokens[k].text in texts


def _parameters(found: Found, bracket: Token, prefix: str) -> None:
    """Named parameters of Go: names before a type, one node for names that share it."""
    parts: list[list[Token]] = [[]]
    for token in bracket.inside:
        if token.text == ",":
            parts.append([])
        else:
            parts[-1].append(token)
    parts = [p for p in parts if p]
    named = any(len(p) > 1 and p[0].kind == "word" and p[0].text not in ("func", "map", "chan", "struct", "interface") and p[1].text != "." for p in parts)
    if not named:
        return
    first = None
    for part in parts:
        first = first or part[0]
        if len(part) > 1:
            kind = "variadic_parameter_declaration" if part[1].text == "..." else "parameter_declaration"
            found.symbols.append((kind, first.text, f"{prefix}.{first.text}".lstrip("."), first.start, part[-1].end))
            first = None


def _go(tokens: list[Token], found: Found, prefix: str) -> None:
    k = 0
    while k < len(tokens):
        token = tokens[k]
        if token.text == "import" and token.first and token.kind == "word":
            if _is(tokens, k + 1, "("):
                group = tokens[k + 1]
                found.imports += [("import_declaration", token.start, group.end), ("import_spec_list", group.start, group.end)]
                for j, spec in enumerate(group.inside):
                    if spec.kind == "string":
                        before = group.inside[j - 1] if j and not spec.first and group.inside[j - 1].text != ";" else spec
                        found.imports.append(("import_spec", before.start, spec.end))
            else:
                end = _statement_end(tokens, k)
                if end > k + 1:
                    found.imports += [("import_declaration", token.start, tokens[end - 1].end), ("import_spec", tokens[k + 1].start, tokens[end - 1].end)]
        elif token.text == "func" and token.kind == "word":
            at, receiver = k + 1, None
            if token.first and _is(tokens, at, "(") and at + 1 < len(tokens) and tokens[at + 1].kind == "word" and _is(tokens, at + 2, "("):
                receiver, at = tokens[at], at + 1
            if at < len(tokens) and tokens[at].kind == "word" and token.first:
                name = tokens[at]
                words = [t.text for t in receiver.inside if t.kind == "word"] if receiver else []
                own = ".".join(x for x in (words[-1] if words else prefix, name.text) if x)
                head = [t for t in tokens[at + 1 : at + 4] if t.kind == "open"]
                body = _body(tokens, at)
                end = body.end if body else head[-1].end if head else name.end
                found.symbols.append(("method_declaration" if receiver else "function_declaration", name.text, own, token.start, end))
                for bracket in [*([receiver] if receiver else []), *[t for t in head if t.text == "("]]:
                    _parameters(found, bracket, own)
        elif token.text == "type" and token.first and token.kind == "word":
            group = tokens[k + 1].inside if _is(tokens, k + 1, "(") else tokens[k + 1 :]
            for j, name in enumerate(group):
                if (j == 0 or name.first and _is(tokens, k + 1, "(")) and name.kind == "word" and not _is(group, j + 1, "="):
                    end = _statement_end(group, j)
                    found.symbols.append(("type_spec", name.text, name.text, name.start, max(t.end for t in group[j:end])))
                    for t in group[j:end]:
                        if t.text == "{":
                            _go_members(t, found, name.text, any(x.text == "interface" for x in group[j:end]))
                if not _is(tokens, k + 1, "("):
                    break
        if token.kind == "open":
            _go(token.inside, found, prefix)
        k += 1


def _go_members(body: Token, found: Found, owner: str, interface: bool) -> None:
    for j, name in enumerate(body.inside):
        if not (name.first or j == 0 or body.inside[j - 1].text == ";") or name.kind != "word":
            continue
        end = _statement_end(body.inside, j)
        part = body.inside[j:end]
        if interface and _is(part, 1, "("):
            found.symbols.append(("method_elem", name.text, f"{owner}.{name.text}", name.start, part[-1].end))
            _parameters(found, part[1], f"{owner}.{name.text}")
        elif not interface and len(part) > 1 and part[1].text != "." and part[1].kind != "string":
            found.symbols.append(("field_declaration", name.text, f"{owner}.{name.text}", name.start, part[-1].end))


def _script(tokens: list[Token], found: Found, prefix: str, typed: bool, members: str = "") -> None:
    """``members``: class or interface, where the tokens are a body of one."""
    kinds = {"interface": "interface_declaration", "enum": "enum_declaration"} if typed else {}
    k = 0
    while k < len(tokens):
        token, inner, follow = tokens[k], prefix, ""
        before = tokens[k - 1].text if k else ""
        name = tokens[k + 1] if k + 1 < len(tokens) and tokens[k + 1].kind == "word" else None
        starts = not k or token.first or before in (";", "export", "default", "async", "declare", "abstract", "}") or tokens[k - 1].kind == "open"
        if members and token.kind in ("word", "string") and _is(tokens, k + 1, "(") and before not in (".", "new", "=", "(", "@"):
            body = _body(tokens, k + 1)
            if body or members == "interface":
                j = k + 1 if body is None else tokens.index(body)
                own = f"{prefix}.{token.text}".lstrip(".")
                start = k
                while start and tokens[start - 1].text in ("async", "static", "get", "set", "*", "public", "private", "protected", "readonly"):
                    start -= 1
                found.symbols.append(("method_definition" if body else "method_signature", token.text, own, tokens[start].start, tokens[j].end))
                if body:
                    _script(body.inside, found, own, typed)
                    k = j
        elif token.kind == "word" and token.text == "import" and before != ".":
            if _is(tokens, k + 1, "("):
                found.imports.append(("import", token.start, token.end))
            elif starts:
                end = _statement_end(tokens, k)
                own = tokens[k + 1 : end]
                last = tokens[end] if end < len(tokens) and tokens[end].text == ";" else tokens[end - 1]
                found.imports.append(("import_statement", token.start, last.end))
                source = next((j for j, t in enumerate(own) if t.text == "from"), None)
                if source:
                    found.imports.append(("import_clause", own[0].start, own[source - 1].end))
                    for j, t in enumerate(own[:source]):
                        if t.text == "{":
                            found.imports.append(("named_imports", t.start, t.end))
                            cuts = [-1, *[n for n, x in enumerate(t.inside) if x.text == ","], len(t.inside)]
                            found.imports += [("import_specifier", t.inside[a + 1].start, t.inside[b - 1].end) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
                        elif t.text == "*" and j + 2 < source + 1:
                            found.imports.append(("namespace_import", t.start, own[source - 1].end))
                k = end - 1
        elif token.kind == "word" and starts and token.text == "function":
            star = _is(tokens, k + 1, "*")
            name = tokens[k + 2] if star and k + 2 < len(tokens) and tokens[k + 2].kind == "word" else name
            body = _body(tokens, k + 1)
            if name is not None and body:
                inner = f"{prefix}.{name.text}".lstrip(".")
                start = tokens[k - 1].start if before == "async" else token.start
                found.symbols.append(("generator_function_declaration" if star else "function_declaration", name.text, inner, start, body.end))
                follow = "block"
        elif token.kind == "word" and starts and name is not None and (token.text == "class" or token.text in kinds):
            body = _body(tokens, k + 1)
            if body:
                inner = f"{prefix}.{name.text}".lstrip(".")
                kind = "abstract_class_declaration" if before == "abstract" else kinds.get(token.text, "class_declaration")
                found.symbols.append((kind, name.text, inner, tokens[k - 1].start if before == "abstract" else token.start, body.end))
                follow = token.text if token.text != "enum" else "block"
        elif typed and token.text == "type" and starts and name is not None and (_is(tokens, k + 2, "=") or _is(tokens, k + 2, "<")):
            end = _statement_end(tokens, k)
            found.symbols.append(("type_alias_declaration", name.text, f"{prefix}.{name.text}".lstrip("."), token.start, tokens[min(end, len(tokens) - 1)].end))
        if follow:
            for j in range(k + 1, len(tokens)):
                _script(tokens[j].inside, found, inner, typed, follow if tokens[j] is body and follow != "block" else "")
                if tokens[j] is body:
                    k = j
                    break
        elif k < len(tokens) and tokens[k].kind == "open" and tokens[k] is token:
            _script(token.inside, found, prefix, typed)
        k += 1


def _other(tokens: list[Token], found: Found, prefix: str) -> None:
    for k, token in enumerate(tokens):
        inner = prefix
        if token.kind == "word" and token.text in _HEADS and (not k or tokens[k - 1].text not in (".", "=", "new")):
            name = tokens[k + 1] if k + 1 < len(tokens) else None
            if name is not None and name.kind == "word" and name.text not in _HEADS:
                body = _body(tokens, k + 1)
                inner = f"{prefix}.{name.text}".lstrip(".")
                found.symbols.append(("declaration", name.text, inner, token.start, body.end if body else name.end))
        if token.kind == "open":
            _other(token.inside, found, prefix)


def islands(text: str, language: str) -> Found:
    """What a file declares and imports, in the order of the text."""
    tokens, errors = tree(text, language)
    found = Found(errors=errors)
    if language == "go":
        _go(tokens, found, "")
    elif language in ("javascript", "typescript"):
        _script(tokens, found, "", language == "typescript")
    else:
        _other(tokens, found, "")
    found.symbols.sort(key=lambda s: (s[3], -s[4]))
    found.imports.sort(key=lambda s: (s[1], -s[2]))
    return found

"""Tokens and structure of one source file, from tables.

A family of languages is a row of ``LANGUAGES``: its comments and strings, how its blocks open and
close (``brace``, ``end`` words, ``indent`` or ``statement``), whether a line's end ends a statement,
and its declaring words.  ``tokens`` runs the lexer's states (code, comment, string, template, regular
expression, heredoc); ``outline`` keeps a stack over the tokens and gives the lines at which top-level
parts start, and the declarations as ``kind, name, line``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

LINE, ONE, MANY, CHAR = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r'"(?:\\.|[^"\\])*"?', r"'(?:\\[^'\n]*|[^'\\\n])'"
TRIPLE, TRIPLE_ONE, RAW, SPAN = r'"""(?:\\.|(?!""").)*(?:""")?', r"'''(?:\\.|(?!''').)*(?:''')?", r"`[^`]*`?", r"'(?:\\.|[^'\\])*'?"
HEREDOC = r"<<<?[-~]?(?P<q>['\"]?)(?P<mark>[A-Za-z_]\w*)(?P=q)[^\n]*\n(?:(?!\s*(?P=mark)\b)[^\n]*\n)*\s*(?P=mark)\b"


@dataclass(frozen=True)
class Family:
    shape: str = "brace"
    line: str = "//"
    block: tuple[str, str] | None = ("/*", "*/")
    nested: bool = False  # comments in comments
    strings: tuple[str, ...] = (LINE, ONE)
    templates: bool = False
    regexes: bool = False
    newline: bool = False
    directives: bool = False
    typed: bool = False  # functions are declared by type and name, without a word
    script: bool = False  # functions are values: bound by = or :
    words: dict[str, str] = field(default_factory=dict)
    opens: frozenset[str] = frozenset()


F = "function"
_SCRIPT = {"function": F, "class": "class"}
_TYPES = {**_SCRIPT, "interface": "interface", "enum": "enum", "type": "type", "namespace": "module", "module": "module"}
_C = {"struct": "struct", "union": "struct", "enum": "enum"}
_CPP = {**_C, "class": "class", "namespace": "module"}
_JAVA = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}
LANGUAGES: dict[str, Family] = {
    "javascript": Family(templates=True, regexes=True, newline=True, script=True, words=_SCRIPT),
    "typescript": Family(templates=True, regexes=True, newline=True, script=True, words=_TYPES),
    "go": Family(strings=(LINE, RAW, CHAR), newline=True, words={"func": F, "type": "type"}),
    "rust": Family(nested=True, strings=(r'b?r(?P<h>#*)".*?"(?P=h)', MANY, CHAR), words={"fn": F, "struct": "struct", "enum": "enum", "union": "struct", "trait": "interface", "mod": "module", "type": "type", "impl": ""}),
    "java": Family(strings=(TRIPLE, LINE, ONE), typed=True, words=_JAVA),
    "csharp": Family(strings=(r'\$?@"(?:""|[^"])*"', TRIPLE, LINE, ONE), typed=True, directives=True, words={**_JAVA, "struct": "struct", "namespace": "module"}),
    "c": Family(strings=(LINE, CHAR), typed=True, directives=True, words=_C),
    "cpp": Family(strings=(r'R"(?P<h>[^(\s]*)\(.*?\)(?P=h)"', LINE, CHAR), typed=True, directives=True, words=_CPP),
    "objc": Family(strings=(LINE, CHAR), typed=True, directives=True, words=_C),
    "kotlin": Family(nested=True, strings=(TRIPLE, LINE, CHAR), newline=True, words={"fun": F, "class": "class", "interface": "interface", "object": "class", "typealias": "type"}),
    "swift": Family(nested=True, strings=(TRIPLE, LINE), newline=True, words={"func": F, "class": "class", "struct": "struct", "enum": "enum", "protocol": "interface", "extension": "", "actor": "class", "typealias": "type"}),
    "scala": Family(nested=True, strings=(TRIPLE, LINE, CHAR), newline=True, words={"def": F, "class": "class", "trait": "interface", "object": "class", "type": "type", "enum": "enum"}),
    "dart": Family(strings=(TRIPLE, TRIPLE_ONE, LINE, ONE), typed=True, words={"class": "class", "enum": "enum", "mixin": "class", "extension": "class"}),
    "php": Family(line="//|#(?!\\[)", strings=(HEREDOC, MANY, SPAN), words={"function": F, "class": "class", "interface": "interface", "trait": "class", "enum": "enum", "namespace": "module"}),
    "zig": Family(block=None, strings=(LINE, CHAR), words={"fn": F, "struct": "struct", "enum": "enum", "union": "struct"}),
    "bash": Family(line=r"(?<![^\s;(])#", block=None, strings=(HEREDOC, MANY, r"'[^']*'?"), newline=True, words={"function": F}),
    "perl": Family(line="#", block=None, strings=(HEREDOC, MANY, SPAN), words={"sub": F, "package": "module"}),
    "proto": Family(words={"message": "class", "service": "interface", "enum": "enum", "rpc": F}),
    "graphql": Family(line="#", block=None, strings=(TRIPLE, LINE), newline=True, words={"type": "type", "interface": "interface", "input": "type", "enum": "enum", "union": "type", "scalar": "type"}),
    "css": Family(line=r"(?!)"),
    "scss": Family(),
    "hcl": Family(line="//|#", strings=(HEREDOC, LINE), newline=True),
    "ruby": Family("end", "#", (r"^=begin", r"^=end"), strings=(HEREDOC, MANY, SPAN, r"%[wWiIqQ](?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})", RAW), regexes=True, newline=True,
                   words={"def": F, "class": "class", "module": "module"}, opens=frozenset("def class module begin case do if unless while until for".split())),
    "lua": Family("end", "--(?!\\[=*\\[)", ("--[[", "]]"), strings=(r"\[(?P<e>=*)\[.*?\](?P=e)\]", LINE, ONE), newline=True, words={"function": F}, opens=frozenset("function do if repeat".split())),
    "julia": Family("end", "#(?!=)", ("#=", "=#"), nested=True, strings=(TRIPLE, MANY, CHAR), newline=True,
                    words={"function": F, "macro": F, "struct": "struct", "module": "module", "type": "type"}, opens=frozenset("function macro struct module begin let quote try do if for while".split())),
    "elixir": Family("end", "#", None, strings=(TRIPLE, TRIPLE_ONE, MANY, SPAN), newline=True,
                     words={"def": F, "defp": F, "defmacro": F, "defmodule": "module", "defprotocol": "interface", "defimpl": ""}, opens=frozenset("do fn".split())),
    "python": Family("indent", "#", None, strings=(r'[rRbBfFuU]{0,2}' + TRIPLE, r"[rRbBfFuU]{0,2}" + TRIPLE_ONE, LINE, ONE), newline=True, words={"def": F, "class": "class"}),
    "nim": Family("indent", "#(?!\\[)", ("#[", "]#"), nested=True, strings=(TRIPLE, LINE, CHAR), newline=True, words={"proc": F, "func": F, "iterator": F, "template": F, "macro": F, "method": "method"}),
    "sql": Family("statement", "--", strings=(r"\$(?P<d>\w*)\$.*?\$(?P=d)\$", r"'(?:''|[^'])*'?", r'"[^"]*"?', r"`[^`]*`?")),
}
LANGUAGES |= {"tsx": LANGUAGES["typescript"], "less": LANGUAGES["scss"]}

#: May stand before a declaring word.
MODIFIERS = frozenset("export default public private protected static abstract final async pub unsafe inline extern const virtual override open internal sealed data inner suspend partial readonly declare mutating constexpr friend explicit case implicit lazy annotation value companion mutable local fileprivate indirect native synchronized strictfp required convenience nonisolated crate typedef ref base mixin factory external template".split())
FLOW = frozenset("if for while switch catch return else do with try finally foreach using lock fixed match when guard loop synchronized new throw await yield case sizeof defer select unless until elseif elif function fn fun func".split())
#: The statement goes on behind a closed block, or on the next line, where one of these comes.
GOES_ON = frozenset(") ] } , . ; ? : = ( [ { else catch finally extends implements where && || | & + * / % == => -> ?. ?? && from".split())
BINDS_ON = frozenset("= + - * / % & | ^ < : , . @ => -> && || == :: ?.".split())
NO_VALUE = frozenset("return typeof case in of delete void throw new else do and or not if unless when while until yield await puts".split())
REGEX = re.compile(r"/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(?:`|\$\{)?", re.S)
WORD = re.compile(r"[^\W\d][\w$]*[?!]?$|[$@#]+[\w$]+$|~[\w]+$")


@cache
def _pattern(language: str) -> re.Pattern:
    f = LANGUAGES[language]
    mark = {"ruby": r"[$@]{1,2}\w+|[^\W\d]\w*[?!](?!=)|", "php": r"\$\w+|", "rust": r"'[^\W\d]\w*|", "elixir": r"[^\W\d]\w*[?!]|", "bash": r"\$\w+|\$[#?@*!$-]|[\w./-]*[^\W\d][\w./-]*|", "julia": r"[^\W\d]\w*!(?!=)|", "cpp": r"~[^\W\d]\w*|", "perl": r"[$@%]\w+|"}.get(language, "")
    parts = [r"(?P<space>[^\S\n]+|\\\n" + (r"|<\?(?:php|=)?|\?>" if language == "php" else "") + ")", r"(?P<newline>\n)"]
    if f.directives:
        parts.append(r"(?P<directive>^[^\S\n]*#(?:\\\n|[^\n])*)")
    if f.block:
        start = f.block[0] if f.block[0].startswith("^") else re.escape(f.block[0])
        parts.append(f"(?P<block>{start})")
    parts.append(f"(?P<comment>(?:{f.line})[^\\n]*)")
    named = lambda i, s: re.sub(r"\(\?P([<=])(\w+)", lambda m: f"(?P{m[1]}{m[2]}{i}", s)
    parts.append("(?P<string>" + "|".join(named(i, s) for i, s in enumerate(f.strings)) + ")")
    parts += [f"(?P<word>{mark}[^\\W\\d][\\w$]*|\\$[\\w$]*)", r"(?P<number>\d[\w.]*)", r"(?P<punct>=>|->|::|\?\.|&&|\|\||==|<-|.)"]
    return re.compile("|".join(parts), re.S | re.M)


def _block_end(code: str, at: int, f: Family) -> int:
    start, end = f.block
    if end.startswith("^"):
        m = re.compile(end + r"[^\n]*", re.M).search(code, at)
        return m.end() if m else len(code)
    depth = 0
    for m in re.compile(f"{re.escape(start)}|{re.escape(end)}").finditer(code, at):
        depth += 1 if m[0] == start and (f.nested or not depth) else -1 if m[0] == end else 0
        if not depth:
            return m.end()
    return len(code)


def tokens(code: str, language: str) -> Iterator[tuple[str, str, int, int]]:
    """``kind, text, line, column`` without spaces; kinds: newline, comment, directive, string, word, number, punct."""
    f, match, size, at, line, begin = LANGUAGES[language], _pattern(language).match, len(code), 0, 1, 0
    resume: list[int] = []  # how deep in braces each open template is
    depth, last = 0, ""
    while at < size:
        if code[at] == " ":  # most of the space there is
            at += 1
            continue
        m = match(code, at)
        kind, text, end = m.lastgroup, m[0], m.end()
        if kind == "word":
            yield kind, text, line, at - begin
            last, at = text, end
            continue
        if kind == "block":
            kind, end = "comment", _block_end(code, at, f)
        elif kind == "punct":
            if text == "{":
                depth += 1
            elif text == "}" or text == "`" and f.templates:
                goes_on = text == "}" and resume and depth == resume[-1]
                depth -= text == "}" and not goes_on
                if f.templates and (text == "`" or goes_on):
                    end = TEMPLATE.match(code, at + 1).end()
                    if goes_on:
                        resume.pop()
                    if code.endswith("${", at + 1, end):
                        resume.append(depth)
                    kind = "string"
            elif text == "/" and f.regexes and (not WORD.match(last) and last[-1:] not in ")]0\"" or last in NO_VALUE) and (r := REGEX.match(code, at)):
                kind, end = "string", r.end()
            if kind == "punct":
                yield kind, text, line, at - begin
                last, at = text, end
                continue
        text = code[at:end]
        if kind != "space":
            yield kind, text, line, at - begin
            if kind not in ("comment", "newline"):
                last = "0" if kind == "number" else '"' if kind == "string" else text
        if "\n" in text:
            line += text.count("\n")
            begin = at + text.rindex("\n") + 1
        at = end


class Frame:
    """An open bracket: the words of its current statement, each with its line."""

    def __init__(self, opened: str, scope: str):
        self.opened, self.scope, self.head, self.over = opened, scope, [], False


def _drop_generics(words: list) -> list:
    out, depth = [], 0
    for w in words:
        if w[0] == "<" and (depth or out and WORD.match(out[-1][0])):
            depth += 1
        elif depth:
            depth -= w[0] == ">"
        else:
            out.append(w)
    return words if depth else out


MARKS = frozenset("@#<")


def _bare(head: list) -> list:
    """Without annotations and type parameters."""
    if MARKS.isdisjoint([t for t, _ in head]):
        return head
    out, k = [], 0
    while k < len(head):
        if head[k][0] in ("@", "#") and k + 1 < len(head):
            k += 2 if head[k + 1][0] != "interface" else 1
            while k < len(head) and head[k][0] in (".", "()") or k < len(head) and head[k - 1][0] == ".":
                k += 1
            continue
        out.append(head[k])
        k += 1
    if out and out[0][0] in ("template", "fun", "impl") and len(out) > 1 and out[1][0] == "<":
        out.insert(1, ("_", 0))
        out = [w for w in _drop_generics(out) if w[0] != "_"]
    return _drop_generics(out)


def declared(head: list, scope: str, f: Family, body: bool) -> tuple[str, str, int, str] | None:
    """``kind, name, line, inner scope`` of a statement's words; the name is empty where it has none."""
    if not head:
        return None
    w = _bare(head)
    texts = [t for t, _ in w]
    method = lambda kind: "method" if kind == F and scope == "class" else kind
    inner = lambda kind: {F: "body", "method": "body", "module": "space"}.get(kind, "class")
    k = 0
    while k < len(w) and texts[k] not in f.words and (texts[k] in MODIFIERS or texts[k] == "()" and k or texts[k][:1] in "\"'"):
        k += 1
    if k < len(w) and texts[k] in f.words and not (f.typed and "()" in texts and "=" not in texts and f.words[texts[k]] in ("struct", "enum") and len(texts) > 2 and texts[-2:-1] != [texts[k]] and texts[k + 2 : k + 3] != ["()"] and texts[k + 2 : k + 3] != [":"]):
        kind, n = f.words[texts[k]], k + 1
        if n < len(w) and texts[n] in f.words and f.words[texts[n]] in ("class", "struct"):  # enum class, fun interface
            n += 1
        while n < len(w) and (texts[n] in ("*", "&") or texts[n] == "()" and n + 1 < len(w) and WORD.match(texts[n + 1])):
            n += 1
        if texts[k] == "impl" or kind == "":
            return "", "", w[k][1], "class"
        while n + 2 < len(w) and texts[n + 1] in (".", "::", ":") and WORD.match(texts[n + 2]) and (f.shape == "end" or kind in (F, "module")) and not texts[n + 1] == ":" * (f.shape != "end"):
            n += 2
        named = n < len(w) and WORD.match(texts[n]) and texts[n] not in ("extends", "implements")
        if named and not (kind == "type" and not body and texts[n + 1 : n + 2] == ["."]):
            if not body and f.typed and kind in ("struct", "enum", "class", "interface") and not texts[k] == "record":
                return ("type", texts[-1], w[-1][1], "block") if texts[0] == "typedef" and len(w) > 2 and WORD.match(texts[-1]) else None
            return method(kind), texts[n], w[n][1], inner(kind)
        if texts[0] == "typedef" and not body and WORD.match(texts[-1]):
            return "type", texts[-1], w[-1][1], "block"
        if body and (n == len(w) or texts[n] in ("()", "{}", ":", "extends")) and (kind != "type"):
            return "", "", w[k][1], inner(kind)
    if f.typed and texts[:1] == ["typedef"] and not body and len(w) > 2 and WORD.match(texts[-1]):
        return "type", texts[-1], w[-1][1], "block"
    # a function or a class as a value: name = ..., name: ...
    for at in [i for i, t in enumerate(texts) if t in ("=", ":")][:4]:
        rest = [t for t in texts[at + 1 :] if t not in ("async", "static")]
        value = rest[:1] and (f.words.get(rest[0]) if rest[0] in f.words else F if rest[:2] in (["()", "=>"],) or len(rest) > 1 and rest[1] == "=>" and WORD.match(rest[0]) else None)
        if rest[:1] == ["()"] and "=>" in rest and rest[1:2] == [":"]:
            value = F
        if value and (f.script or texts[at] == "="):
            names = [i for i in range(at) if WORD.match(texts[i]) and texts[i] not in MODIFIERS | {"let", "var"}]
            if names and (texts[at] == "=" or f.script):
                n = names[0] if ":" in texts[:at] else names[-1]
                return method(value), texts[n].lstrip("$"), w[n][1], inner(value)
    if (f.typed and scope in ("file", "space", "class")) or (f.script and scope == "class") or (f.line.startswith("(?<!") and body):
        cut = next((i for i, t in enumerate(texts) if i and t in (":", "->", "=>", "=", "throws", "where", "const", "noexcept", "override", "extends") and "()" in texts[:i]), len(texts))
        own = texts[:cut]
        if len(own) > 1 and own[-1] == "()" and WORD.match(own[-2]) and not FLOW & set(own) and "=" not in own and (body or len(own) > 2 or f.script and scope == "class"):
            if "=" in texts[cut : cut + 1] and not body:
                return None
            name = own[-2]
            return ("method" if scope == "class" else F), name, w[cut - 2][1], "body"
    return None


def _braces(all_tokens: list, language: str) -> tuple[list[int], list[tuple[str, str, int]]]:
    f, stack = LANGUAGES[language], [Frame("", "file")]
    starts: list[int] = []
    found: list[tuple[str, str, int]] = []

    def say(d) -> None:
        if d and d[1] and d[0]:
            found.append((d[0], d[1], d[2]))

    def close(top: Frame) -> None:
        if top.head and not any(t == "{}" for t, _ in top.head[-1:]) or top.head and top.head[0][0] == "typedef":
            if top.opened in ("", "{") or top.scope == "types":
                say(("type", top.head[0][0], top.head[0][1]) if top.scope == "types" and WORD.match(top.head[0][0]) else declared(top.head, top.scope, f, False))
        top.head, top.over = [], False

    for kind, text, line, _ in all_tokens:
        if kind == "comment":
            continue
        top = stack[-1]
        if kind == "newline":
            if f.newline and top.head and top.head[-1][0] not in BINDS_ON and (top.opened in ("", "{") or top.scope == "types") and not (top.head[0][0] == "@" and len(_bare(top.head)) == 0):
                top.over = True
            continue
        if kind == "directive":
            if len(stack) == 1 and not top.head:
                starts.append(line)
            continue
        if top.over:
            if text not in GOES_ON and not (text == "while" and top.head[0][0] == "do"):
                close(top)
            top.over = False
        if not top.head and len(stack) == 1 and text not in (")", "]", "}", ";"):
            starts.append(line)
        if kind != "punct":
            top.head.append((text if kind != "string" else '"', line))
        elif text in ("(", "["):
            types = text == "(" and [t for t, _ in top.head] == ["type"] and language == "go"
            stack.append(Frame(text, "types" if types else "group"))
        elif text == "{":
            scope = top.scope if top.opened in ("", "{") else "types" if top.scope == "types" else "body"
            d = ("type", top.head[0][0], top.head[0][1], "class") if scope == "types" and top.head else declared(top.head, scope, f, True)
            say(d)
            top.over = False
            space = top.head and top.head[0][0] in ("extern", "namespace") and not d
            stack.append(Frame("{", d[3] if d else "space" if space else "body"))
            stack[-1].ends = not _needs_more(top.head, d, f)
        elif text in (")", "]", "}"):
            want = {")": "(", "]": "[", "}": "{"}[text]
            if not any(s.opened == want for s in stack):
                continue
            while stack[-1].opened != want:
                stack.pop()
            gone = stack.pop()
            if gone.head and gone.opened == "{" or gone.scope == "types":
                close(gone)
            top = stack[-1]
            top.head.append((want + text, line))
            if text == "}":
                top.over = gone.ends
        elif text == ";":
            close(top)
        elif text == "," and (len(top.head) > 200 or top.scope in ("group", "body") or language == "javascript" and top.scope == "file"):
            top.head = [(",", line)]  # a list's next entry; long lists are not carried along
        else:
            top.head.append((text if kind != "string" else '"', line))
    for top in reversed(stack):
        close(top)
    return starts, found


def _needs_more(head: list, d, f: Family) -> bool:
    """Whether a statement goes on behind the block that opens now."""
    texts = [t for t, _ in head]
    if d and d[3] == "body" and "=" not in texts:
        return False
    if "=" in texts:
        return not f.newline
    first = texts[0] if texts else ""
    return first in ("typedef", "use", "return", "import") or f.directives and not f.newline and first in ("struct", "union", "enum", "class") and f.words is not LANGUAGES["csharp"].words


def _ends(all_tokens: list, language: str) -> tuple[list[int], list[tuple[str, str, int]]]:
    """Languages whose blocks end by a word, or by indentation."""
    f, stack, starts, found = LANGUAGES[language], [], [], []  # stack: opening word or column, scope
    head: list = []
    brackets, fresh, column, scope, attached = 0, True, 0, "file", False

    def finish() -> None:
        if head and (d := declared(head, scope, f, True)) and d[1] and d[0]:
            found.append((d[0], d[1], d[2]))
        head.clear()

    for kind, text, line, col in all_tokens:
        if kind == "comment":
            continue
        if kind == "newline" or kind == "punct" and text == ";" and f.shape == "end":
            if not brackets and not (head and head[-1][0] in (",", ".", "=", "+", "&&", "||", "\\")):
                attached = f.shape == "indent" and bool(head) and head[0][0] == "@"  # what follows a decorator is its own
                finish()
                fresh = True
            continue
        if f.shape == "indent" and fresh and not brackets:
            while stack and col <= stack[-1][0]:
                stack.pop()
            column = col
        if fresh and not brackets and (not stack if f.shape == "end" else col == 0) and text not in ("end", "until") and not (f.shape == "indent" and (attached or text in ("else", "elif", "except", "finally"))):
            starts.append(line)
        if not head:
            scope = stack[-1][1] if stack else "file"
        first, before = head[0][0] if head else text, head[-1][0] if head else ""
        if f.shape == "end" and kind == "word" and before not in (".", ":", "::"):
            at_start = not head or before in ("=", "(", ",", "then", "else", "do", "||", "&&", ">")
            modifier = language in ("ruby", "lua", "julia") and text in ("if", "unless", "while", "until", "for", "begin", "case") and not at_start
            again = text == "do" and first in ("while", "until", "for") and language in ("ruby", "julia", "lua") and language != "lua"
            if text in ("end", "until" if language == "lua" else "end"):
                if stack:
                    stack.pop()
            elif text in f.opens and not modifier and not again and not (language == "elixir" and text == "do" and code_follows(head)):
                if text == "struct" and before == "" or text != "struct" or before == "mutable":
                    d = declared(head, scope, f, True) if text == "do" and head else None
                    stack.append((text, d[3] if d else "class" if text in f.words and f.words[text] != F else "body"))
        if kind == "punct" and text in "([{":
            brackets += 1
            if brackets == 1:
                head.append(("()", line))
        elif kind == "punct" and text in ")]}":
            brackets = max(0, brackets - 1)
        elif not brackets:
            if f.shape == "indent" and text == ":" and head and head[0][0] in ("class", "def", "async"):
                stack.append((column, "class" if head[0][0] == "class" else "body"))
                finish()
                head.append(("", line))
            else:
                if f.shape == "end" and text == "=" and kind == "punct" and head and head[0][0] == "def" and stack and stack[-1][0] == "def" and (before == "()" or len(head) == 2):
                    stack.pop()  # a method in one line
                head.append((text if kind != "string" else '"', line))
        fresh = False
    finish()
    return starts, found


def code_follows(head: list) -> bool:
    """``do:`` is no block."""
    return bool(head) and head[-1][0] == ","


def _statements(all_tokens: list, language: str) -> tuple[list[int], list[tuple[str, str, int]]]:
    starts, found, head, depth = [], [], [], 0
    for kind, text, line, _ in [*all_tokens, ("punct", ";", 0, 0)]:
        if kind in ("newline", "comment"):
            continue
        if kind == "punct" and text == ";":
            words = [t.lower() for t, _ in head]
            kinds = [k for k, t in enumerate(words) if t in ("table", "view", "function", "procedure", "index", "trigger", "type", "schema", "sequence", "database")]
            if words[:1] == ["create"] and kinds:
                k = kinds[0] + 1
                k += 3 * (words[k : k + 3] == ["if", "not", "exists"])
                while k + 2 < len(head) and head[k + 1][0] == ".":
                    k += 2
                if k < len(head) and head[k][0] != "(":
                    found.append((words[kinds[0]], head[k][0].strip('"`'), head[k][1]))
            head, depth = [], 0
            continue
        if not head:
            starts.append(line)
        depth += text in ("(", "[")
        if depth == 0 or not head:
            head.append((text, line))
        depth -= text in (")", "]") and depth > 0
    return starts, found


def outline(code: str, language: str) -> tuple[list[int], list[tuple[str, str, int]], set[int]]:
    """Lines at which top-level parts start; declarations in order, each once by name and line; lines
    that hold a comment from their first sign on."""
    f, read = LANGUAGES[language], list(tokens(code, language))
    starts, found = (_braces if f.shape == "brace" else _statements if f.shape == "statement" else _ends)(read, language)
    named = [(k, n[:200], at) for k, n, at in found if n not in FLOW]
    remarks: set[int] = set()
    for k in [k for k, t in enumerate(read) if t[0] == "comment"]:
        if not k or read[k - 1][0] == "newline":
            _, text, line, _ = read[k]
            remarks.update(range(line, line + text.count("\n") + 1))
    return list(dict.fromkeys(starts)), sorted({(n, at): (k, n, at) for k, n, at in reversed(named)}.values(), key=lambda s: (s[2], s[1])), remarks

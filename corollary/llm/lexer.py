"""A lexer of assignments in source code, configuration and prose: pairs of a target's name and a literal.

One pass from left to right. Names, strings (plain, triple, raw, formatted, with references), bare
values, operators, brackets, XML elements, here-documents, YAML blocks and INI sections are recognised
by patterns that never look back, so the time is in proportion to the text. A table of symbols keeps
what was assigned to each name, and a name that is assigned another's value gets that literal, whose
spans stay where the literal stands.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

Part = tuple[str, int, int]

OPENING = re.compile(r"(?i:[bfru]{0,2})[\"'`]")
STRING = re.compile(r"""(?P<mark>[A-Za-z]{0,2})(?:"(?P<double>(?:[^"\\\n]++|\\.)*+)"?|'(?P<single>(?:[^'\\\n]++|\\.)*+)'?|`(?P<back>[^`\n]*+)`?)""")
NAME = re.compile(r"[A-Za-z_$@][\w$]*+(?:(?:\.|-(?![->])|::|->|\?\.)[A-Za-z_]\w*+)*+", re.ASCII)
NUMBER = re.compile(r"\d[\w.]*+", re.ASCII)
SKIP = re.compile(r"[^\nA-Za-z0-9_$@\"'`<(\[{}\]),;\\]++")
ASSIGN = re.compile(r"[ \t]*+(?P<closer>\]?)[ \t]*+(?::=|=>|\?=|\+=|\|\|=|=(?![=~>])|:(?![:/=]))")
TYPED = re.compile(r"[ \t]*+:[ \t]*+[A-Za-z_][\w.]*+(?:[<\[][\w., ]*+[>\]])?\??[ \t]*+=(?![=~>])", re.ASCII)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
CODE = re.compile(r"[A-Za-z_$][\w$]*+(?:(?:\.|::|->|\?\.)[A-Za-z_]\w*+)*+\Z", re.ASCII)
MORE = re.compile(r"[ \t]*+[+.]{1,2}[ \t]*+[\"'`A-Za-z_]|[ \t]*+[\"'`(\[]")
REFERENCE = re.compile(r"\$?\{\{?[ \t]*+([A-Za-z_][\w.]*+)[^{}\n]*+\}\}?|\$\(?([A-Za-z_]\w*+)\)?|%\(([A-Za-z_]\w*+)\)s", re.ASCII)
BLANKS = re.compile(r"[ \t]*+")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*+)(?:[ \t\n][^<>]*+)?>([^<>]*+)</\1[ \t]*+>")
TAG = re.compile(r"<[A-Za-z_][\w.:\-]*+[ \t\n]([^<>]*+)>")
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:\-]*+)[ \t\n]*+=[ \t\n]*+(?:"([^"]*+)"|'([^']*+)')""")
SECTION = re.compile(r"[ \t]*+\[+[ \t]*+\"?([A-Za-z_][\w.\- ]*+)\"?[ \t]*+\]+[ \t]*+(?:[#;][^\n]*+)?(?=\n|\Z)")
HEREDOC = re.compile(r"<<[-~]?[ \t]*+(['\"]?)([A-Za-z_]\w*+)\1", re.ASCII)
ALONE = re.compile(r"^[ \t]*+([A-Za-z_]\w*+)[ \t;)]*+$", re.ASCII | re.MULTILINE)
BLOCK = re.compile(r"[ \t]*+[|>][+-]?\d?[ \t]*+(?=\n)")
LINE = re.compile(r"([ \t]*+(?:- )?)([^\n]*+)\n?")
#: Where something that the lexer knows may begin.
SIGNS = re.compile(r"[=:<(]|^[ \t]*+\[", re.MULTILINE)

#: Names that say nothing by themselves; calls that read a setting, which their first operand names; verbs of calls that set one.
GENERIC = frozenset("value val data default content text literal raw current plain string".split())
READERS = ("getenv", "environ", "env.get", "getproperty", "get_env", "env.fetch", "config.get")
SETTERS = ("set", "with", "add", "put", "use", "configure", "login", "authenticate")
KEYED = ("name", "key", "id")


def last(name: str) -> str:
    """The innermost part of a dotted name."""
    return re.split(r"\.|::|->", name)[-1]


@dataclass
class Frame:
    """An open expression: whom its value goes to, and what was read of it. In a call each operand is a value."""

    closer: str
    targets: list[str] = field(default_factory=list)
    call: bool = False
    reads: bool = False
    parts: list[Part] = field(default_factory=list)
    operand: int = 0


class Lexer:
    """The assignments of one text; ``pairs`` has (name, literal, spans) of each, in order."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.known: dict[str, list[Part]] = {}
        self.pairs: list[tuple[str, str, list[tuple[int, int]]]] = []
        self.frames = [Frame("")]
        self.parents: list[tuple[int, str]] = []
        self.section = self.key = ""
        self.started, self.indent = 0, 0
        self.chained = -1  # where the value of the last target begins
        self.no_close: set[str] = set()
        self.alone: dict[str, list[int]] | None = None

    def run(self) -> list[tuple[str, str, list[tuple[int, int]]]]:
        text, fresh = self.text, True
        while self.at < len(text):
            if fresh:
                self.flush()
                sign = SIGNS.search(text, self.at)
                if sign is None:
                    break
                self.at = max(self.at, text.rfind("\n", self.at, sign.start()) + 1)
                self.line()
            fresh = self.step()
        while self.frames:
            self.flush()
            self.frames.pop()
        return self.pairs

    # -- what was read
    def value(self, targets: list[str], parts: list[Part]) -> None:
        """An assignment is whole: note it, and keep the literal for names that refer to it."""
        for name in targets if parts else ():
            for key in {name, last(name)}:
                self.known[key] = parts
            shown = name
            if name.lower() in GENERIC:
                shown = ".".join(filter(None, [self.section, *(p for _, p in self.parents if p != name), name]))
            self.pairs.append((shown, "".join(p[0] for p in parts), [(s, e) for _, s, e in parts if e > s]))

    def flush(self) -> None:
        """The innermost expression ends, or in a call an operand of it."""
        frame = self.frames[-1]
        if not (frame.reads and not frame.operand):
            self.value(frame.targets, frame.parts)
        frame.parts = []
        if not frame.call:
            frame.targets = []

    def refer(self, name: str) -> list[Part] | None:
        found = self.known.get(name)
        return found if found is not None else self.known.get(last(name))

    # -- lines
    def line(self) -> None:
        """A line of no open bracket begins: a section, or what stands at some depth of YAML."""
        if m := SECTION.match(self.text, self.at):
            self.section, self.parents, self.at = m[1], [], m.end()
            return
        self.begin(self.at)
        if self.full:
            self.ascend(self.indent)

    def begin(self, at: int) -> None:
        m = LINE.match(self.text, at)
        self.started, self.indent, self.full = at, len(m[1]), bool(m[2].strip())

    def ascend(self, level: int) -> None:
        while self.parents and self.parents[-1][0] >= level:
            self.parents.pop()

    def newline(self) -> bool:
        """Whether an expression, and so the line, ends here."""
        text, frame = self.text, self.frames[-1]
        goes_on = bool(frame.parts) and self.at > 0 and text[self.at - 1] in "+\\"
        self.at += 1
        if len(self.frames) == 1:
            return not goes_on
        self.begin(self.at)
        if not self.full:  # an unclosed bracket does not hold on past a blank line
            while len(self.frames) > 1:
                self.flush()
                self.frames.pop()
            return True
        if frame.closer == "}" and frame.parts and not goes_on:
            self.flush()
        return False

    # -- tokens
    def step(self) -> bool:
        """Read one token; True if a line ended that the next does not go on with."""
        text, at = self.text, self.at
        if at >= len(text):
            return True
        c = text[at]
        if c == "\n":
            return self.newline()
        if c == "\\":
            self.at += 1 if text[at + 1 : at + 2] == "\n" else 2
        elif OPENING.match(text, at) and not (c == "'" and at and text[at - 1].isalnum()):
            self.string()
        elif m := NAME.match(text, at):
            self.word(m)
        elif m := NUMBER.match(text, at):
            self.at = m.end()
        elif c == "<":
            self.markup()
        elif c in "([":
            self.open("])"[c == "("], list(self.frames[-1].targets))
        elif c == "{":
            self.flush()
            self.frames.append(Frame("}"))
            self.at += 1
        elif c in ")]}":
            self.flush()
            if len(self.frames) > 1:
                self.frames.pop()
            self.at += 1
        elif c in ",;":
            self.flush()
            self.frames[-1].operand += 1
            self.at += 1
        else:
            m = SKIP.match(text, at)
            self.at = m.end() if m else at + 1
        return False

    def open(self, closer: str, targets: list[str], reads: bool = False) -> None:
        self.frames.append(Frame(closer, targets, True, reads))
        self.at += 1

    def string(self) -> None:
        """A string: the name of what follows it, or a part of a value."""
        text, at = self.text, self.at
        quote = next(i for i in range(at, at + 3) if text[i] in "\"'`")
        mark, triple = text[at:quote].lower(), text[quote] * 3
        if text[quote] != "`" and triple not in self.no_close and text.startswith(triple, quote):
            close = text.find(triple, quote + 3)
            if close >= 0:
                self.at = close + 3
                self.literal(text[quote + 3 : close], quote + 3, "f" in mark)
                return
            self.no_close.add(triple)
        m = STRING.match(text, at)
        group = next(g for g in ("double", "single", "back") if m[g] is not None)
        if m.end() == m.end(group) and group != "double":
            self.at = quote + 1  # an apostrophe
            return
        self.at = m.end()
        sign = ASSIGN.match(text, m.end())
        if sign and not sign["closer"] and not self.frames[-1].parts:
            self.target(m[group], sign.end(), at)
        else:
            self.literal(m[group], m.start(group), "f" in mark, group != "single")

    def literal(self, body: str, start: int, formatted: bool, expands: bool = False) -> None:
        """Add a string's text to the value; known references in it give their literals."""
        frame, end = self.frames[-1], 0
        if not frame.targets:
            return
        for m in REFERENCE.finditer(body) if formatted or expands else ():
            found = self.refer(m[1] or m[2] or m[3])
            if found is not None or formatted:
                if m.start() > end:
                    frame.parts.append((body[end : m.start()], start + end, start + m.start()))
                frame.parts += found or []
                end = m.end()
        if end < len(body):
            frame.parts.append((body[end:], start + end, start + len(body)))

    def word(self, m: re.Match) -> None:
        """A name: a target, a call, a subscript or a reference."""
        text, name, at = self.text, m.group(), m.start()
        self.at, frame = m.end(), self.frames[-1]
        sign = TYPED.match(text, self.at) or ASSIGN.match(text, self.at)
        if sign and not sign.groupdict().get("closer"):
            self.target(name, sign.end(), at)
        elif text.startswith("(", self.at):
            low, targets = name.lower(), list(frame.targets)
            if not targets and last(low).startswith(SETTERS):
                targets = [name]
            self.open(")", targets, any(r in low for r in READERS))
        elif text.startswith(('["', "['"), self.at):
            own = STRING.match(text, self.at + 1)
            key = own["double"] if own["double"] is not None else own["single"]
            sign = ASSIGN.match(text, own.end())
            if sign and sign["closer"]:
                self.at = own.end()
                self.target(f"{name}.{key}", sign.end(), at)
            else:
                self.at = own.end()
                frame.parts += (self.refer(key) or []) if frame.targets and text.startswith("]", self.at) else []
                self.at += text.startswith("]", self.at)
        elif frame.targets:
            frame.parts += self.refer(name.lstrip("$@")) or []

    def target(self, name: str, at: int, begun: int) -> None:
        """``name``, which begins at ``begun``, is assigned what is at ``at``; in ``a = b = x`` both are."""
        text, frame = self.text, self.frames[-1]
        if frame.targets and not frame.parts and not frame.call and begun == self.chained:
            frame.targets.append(name)
        else:
            self.flush()
            frame.targets, frame.call, frame.reads = [name], False, False
        self.at = at
        if text[at - 1] == ":":
            level = self.indent + len(self.frames) - 1
            self.ascend(level)
            self.parents.append((level, name))
            if m := BLOCK.match(text, at):
                self.block(m.end() + 1)
                return
        self.at = self.chained = BLANKS.match(text, at).end()
        if (m := REFERENCE.match(text, self.at)) and (found := self.refer(m[1] or m[2] or m[3])) is not None:
            frame.parts += found
            self.at = m.end()
            return
        first = NAME.match(text, self.at)
        if first and (ASSIGN.match(text, first.end()) or MORE.match(text, first.end())):
            return  # an expression, with which the pass goes on
        bare = BARE.match(text, self.at)
        if bare is None or OPENING.match(text, self.at):
            return
        chunk = bare.group()
        if CODE.match(chunk) and (self.refer(chunk) is not None or re.search(r"\.|::|->|\$", chunk)):
            return
        frame.parts.append((chunk, bare.start(), bare.end()))
        self.at = bare.end()

    def block(self, at: int) -> None:
        """The more indented lines of a YAML block: each is a literal of the target."""
        targets, base = list(self.frames[-1].targets), self.indent
        self.frames[-1].targets = []
        while at < len(self.text):
            m = LINE.match(self.text, at)
            body = m[2].rstrip()
            if body and len(m[1]) <= base:
                break
            if body:
                self.value(targets, [(body, m.start(2), m.start(2) + len(body))])
            at = max(m.end(), at + 1)
        self.at = min(at, len(self.text)) - 1  # the line's end is seen by the pass

    def markup(self) -> None:
        """A here-document, an XML element with text, or a tag that names a value."""
        text, at = self.text, self.at
        if m := HEREDOC.match(text, at):
            self.heredoc(m)
            return
        m, tag = ELEMENT.match(text, at), TAG.match(text, at)
        if tag:
            found = {}
            for a in ATTRIBUTE.finditer(text, tag.start(1), tag.end(1)):
                group = 2 if a[2] is not None else 3
                found[a[1].lower()] = (a[group], a.start(group))
            label = next((found[k][0] for k in KEYED if k in found), "")
            for name, (body, start) in found.items():
                self.value([label if label and name in GENERIC else name], [(body, start, start + len(body))])
        if m and (body := m[2].strip()):
            start = m.start(2) + len(m[2]) - len(m[2].lstrip())
            if m[1].lower() in KEYED:
                self.key = body
            else:
                self.value([self.key if self.key and m[1].lower() in GENERIC else m[1]], [(body, start, start + len(body))])
                self.key = ""
        self.at = m.end() if m else tag.end() if tag else at + 1

    def heredoc(self, m: re.Match) -> None:
        text = self.text
        if self.alone is None:  # lines of one word, any of which may end a document
            self.alone = {}
            for x in ALONE.finditer(text):
                self.alone.setdefault(x[1], []).append(x.start())
        ends, line = self.alone.get(m[2], []), text.find("\n", m.end())
        k = bisect.bisect_left(ends, line) if line >= 0 else len(ends)
        self.at = m.end()
        if k == len(ends):
            return
        targets = [t for f in self.frames for t in f.targets]
        for row in LINE.finditer(text, line + 1, ends[k]):
            if body := row[2].rstrip():
                self.value(targets, [(body, row.start(2), row.start(2) + len(body))])
        self.begin(ends[k])
        self.at = ALONE.match(text, ends[k]).end(1)


def assignments(text: str) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(name, literal, [(start, end), ...]) of each assignment, with constants put in for their names.

    The spans are those of the source literals, in code points and without quotes: a constant that
    reaches a name through other names is reported where its literal stands.
    """
    return Lexer(text).run()

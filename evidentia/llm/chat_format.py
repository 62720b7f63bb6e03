"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes
nested Python closures that write a conversation and the places of its generation
blocks (the loss mask). The language:

    text                         as it is
    {{ expression }}             its value as text, nothing if null
    {% for x in expression %} ... {% endfor %}       loop.index, loop.first, loop.last inside
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}         text under the loss mask

Expressions have strings, integers, true, false, none, names, ``a.b`` and ``a[b]`` (keys of
mappings and places of lists, never Python attributes), ``~`` (joins texts), ``==``, ``!=``, ``in``,
``not``, ``and``, ``or``, and the filters escape, trim, upper, lower and length. There are no calls.

Escaping. Control strings inside texts get a backslash after their first sign and
backslashes are doubled, so a text never holds a control string and is read back exactly.

Rows of a conversation are ordered by turn, then role and text (null first). Null text is
an empty text, a null role an empty role. Rows with a null conv_id form one conversation.
A conversation is one row of output and is rendered by one task, which streams over its
sorted partition and holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]")

TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)

_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[/TURN\]", re.DOTALL
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class TemplateError(ValueError):
    pass


# Syntax tree ------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Show:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else len(_text(x)),
}


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, (str, int)) else ""


def _get(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _contains(a: object, b: object) -> bool:
    return a in b if isinstance(b, (list, tuple, dict)) or isinstance(a, str) and isinstance(b, str) else False


OPS: dict[str, Callable] = {
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": _contains,
    "not": lambda a: not a,
} | {f"|{name}": f for name, f in FILTERS.items()}

# Parser -----------------------------------------------------------------------

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[.\[\]()~|]))""")
_WORDS = {"true": True, "false": False, "none": None}
DEPTH = 50


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected sign in {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def whole(self) -> object:
        node = self.any()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def any(self) -> object:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        node = self.all()
        while self.take("or"):
            node = Op("or", (node, self.all()))
        self.depth -= 1
        return node

    def all(self) -> object:
        node = self.negated()
        while self.take("and"):
            node = Op("and", (node, self.negated()))
        return node

    def negated(self) -> object:
        flips = 0
        while self.take("not"):
            flips += 1
        node = self.compared()
        return Op("not", (Op("not", (node,)) if flips % 2 == 0 else node,)) if flips else node

    def compared(self) -> object:
        node = self.joined()
        while op := self.take("==", "!=", "in"):
            node = Op(op, (node, self.joined()))
        return node

    def joined(self) -> object:
        node = self.filtered()
        while self.take("~"):
            node = Op("~", (node, self.filtered()))
        return node

    def filtered(self) -> object:
        node = self.item()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = Op(f"|{name}", (node,))
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def item(self) -> object:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        if self.take("("):
            node = self.any()
            self.need(")")
        else:
            kind, token = self.tokens[self.at]
            self.at += 1
            if kind == "string":
                node = Const(token[1:-1])
            elif kind == "int":
                node = Const(int(token))
            elif kind == "name":
                node = Const(_WORDS[token]) if token in _WORDS else Name(token)
            else:
                raise TemplateError(f"unexpected {token!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                node = Get(node, Const(self.name()))
            else:
                node = Get(node, self.any())
                self.need("]")
        return node


class _Parser:
    def __init__(self, template: str):
        self.parts = [p for p in _PARTS.split(template) if p]
        self.at = 0

    def word(self) -> str | None:
        """First word of the tag at this place."""
        part = self.parts[self.at] if self.at < len(self.parts) else ""
        if not (part.startswith("{%") and part.endswith("%}") and len(part) >= 4):
            return None
        return (part[2:-2].split() or [""])[0]

    def tag(self) -> str:
        self.at += 1
        return self.parts[self.at - 1][2:-2].strip()

    def end(self, word: str) -> None:
        if self.word() != word:
            raise TemplateError(f"{word} expected")
        self.at += 1

    def body(self, *ends: str, depth: int = 0) -> tuple:
        if depth > DEPTH:
            raise TemplateError("nested too deeply")
        out: list = []
        while self.at < len(self.parts):
            part, word = self.parts[self.at], self.word()
            if word is None:
                self.at += 1
                is_value = part.startswith("{{") and part.endswith("}}") and len(part) >= 4
                out.append(Show(_Expression(part[2:-2]).whole() if is_value else Const(part)))
            elif word in ends:
                return tuple(out)
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.*)", self.tag(), re.DOTALL)
                if not m:
                    raise TemplateError("for name in expression expected")
                inner = self.body("endfor", depth=depth + 1)
                self.end("endfor")
                out.append(For(m[1], _Expression(m[2]).whole(), inner))
            elif word == "if":
                out.append(self.choice(depth))
            elif word == "generation":
                self.at += 1
                inner = self.body("endgeneration", depth=depth + 1)
                self.end("endgeneration")
                out.append(Generation(inner))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} expected")
        return tuple(out)

    def choice(self, depth: int) -> If:
        _, *rest = self.tag().split(None, 1)
        test = _Expression("".join(rest)).whole()
        yes = self.body("elif", "else", "endif", depth=depth + 1)
        if self.word() == "elif":
            return If(test, yes, (self.choice(depth + 1),))
        no: tuple = ()
        if self.word() == "else":
            self.at += 1
            no = self.body("endif", depth=depth + 1)
        self.end("endif")
        return If(test, yes, no)


def parse(template: str) -> tuple:
    return _Parser(template).body()


# Constant folding -------------------------------------------------------------


def fold(node: object) -> object:
    """An equal expression with constant parts computed."""
    if isinstance(node, Get):
        of, key = fold(node.of), fold(node.key)
        return Const(_get(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Get(of, key)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(OPS[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    return node


def fold_body(body: tuple) -> tuple:
    """Constant branches taken, neighbouring texts joined, empty parts dropped."""
    out: list = []
    for node in body:
        if isinstance(node, Show):
            value = fold(node.value)
            new = [Show(Const(_text(value.value)) if isinstance(value, Const) else value)]
        elif isinstance(node, For):
            new = [For(node.name, fold(node.over), fold_body(node.body))]
        elif isinstance(node, If):
            test, yes, no = fold(node.test), fold_body(node.yes), fold_body(node.no)
            new = list(yes if test.value else no) if isinstance(test, Const) else [If(test, yes, no)]
        else:
            new = [Generation(fold_body(node.body))]
        for x in new:
            is_text = isinstance(x, Show) and isinstance(x.value, Const)
            if is_text and not x.value.value:
                continue
            if is_text and out and isinstance(out[-1], Show) and isinstance(out[-1].value, Const):
                out[-1] = Show(Const(out[-1].value.value + x.value.value))
            else:
                out.append(x)
    return tuple(out)


# Closures ---------------------------------------------------------------------


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)


def _value(node: object) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Get):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _get(of(env), key(env))
    args = tuple(map(_value, node.args))
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    call = OPS[node.op]
    if len(args) == 1:
        return lambda env, a=args[0]: call(a(env))
    return lambda env, a=args[0], b=args[1]: call(a(env), b(env))


def _writer(node: object) -> Callable[[dict, Output], None]:
    if isinstance(node, Show):
        value = _value(node.value)

        def show(env: dict, out: Output) -> None:
            text = _text(value(env))
            out.parts.append(text)
            out.length += len(text)

        return show
    if isinstance(node, For):
        over, body, name = _value(node.over), _block(node.body), node.name

        def loop(env: dict, out: Output) -> None:
            items = over(env)
            items = items if isinstance(items, (list, tuple)) else []
            for i, item in enumerate(items):
                place = {"index": i + 1, "first": i == 0, "last": i + 1 == len(items)}
                body({**env, name: item, "loop": place}, out)

        return loop
    if isinstance(node, If):
        test, yes, no = _value(node.test), _block(node.yes), _block(node.no)
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    body = _block(node.body)

    def generation(env: dict, out: Output) -> None:
        start = out.length
        body(env, out)
        out.spans.append((start, out.length))

    return generation


def _block(body: tuple) -> Callable[[dict, Output], None]:
    writers = tuple(map(_writer, body))

    def block(env: dict, out: Output) -> None:
        for write in writers:
            write(env, out)

    return block


def compiled(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (mappings with role and text) to the text and its loss spans."""
    write = _block(fold_body(parse(template)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        write({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text made with ``TEMPLATE``."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["text"])))
        else:
            role = "user" if m["user"] is not None else "assistant"
            turns.append((role, unescape(m[role])))
        at = m.end()
    return turns


# Spark ------------------------------------------------------------------------

FORMATTED = "conv_id long, n_turns long, formatted string, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _formatter(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)

        def made(conv_id: int | None, turns: list[dict]) -> pa.RecordBatch:
            text, spans = render(turns)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([conv_id], pa.int64()),
                    pa.array([len(turns)], pa.int64()),
                    pa.array([text], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in spans]], _SPANS),
                ],
                ["conv_id", "n_turns", "formatted", "spans"],
            )

        conv_id, turns = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for this, role, text in zip(*columns, strict=True):
                if turns and this != conv_id:
                    yield made(conv_id, turns)
                    turns = []
                conv_id = this
                turns.append({"role": role or "", "text": text or ""})
        if turns:
            yield made(conv_id, turns)

    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, formatted text and loss spans (code points) of every conversation."""
    compiled(template)  # a faulty template fails here, not in a task
    rows = conversations.select("conv_id", "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatter(template), FORMATTED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns_hash, loss_chars, loss_hash, chars = [], [], [], []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            digest = hashlib.sha256()
            for role, own in read_back(text):
                digest.update(f"{role}\n{own}\n".encode())
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            turns_hash.append(digest.hexdigest())
            loss_chars.append(len(loss))
            loss_hash.append(hashlib.sha256(loss.encode()).hexdigest())
            chars.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("n_turns"),
                pa.array(turns_hash, pa.string()),
                pa.array(loss_chars, pa.int64()),
                pa.array(loss_hash, pa.string()),
                pa.array(chars, pa.int64()),
            ],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    return formatted.mapInArrow(_digests, DIGESTS)


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(own).alias("text"),
    )
    return digests(format_conversations(rows.unionByName(extra)))

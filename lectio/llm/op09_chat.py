"""Chat formatting: a small template language, compiled to Python closures.

A template is parsed into a syntax tree, constants are folded, and every node becomes a
closure. Templates are sandboxed by construction: there are no calls, no subscripts and no
attributes beyond ``role`` and ``text`` of a message and ``first``, ``last``, ``index`` of the
loop. A conversation is rendered as a stream, so a conversation of any length needs memory
for one turn and one output part only.

Language::

    {% control '[INST]' '</s>' %}            strings that mark turns
    {% for m in messages %} ... {% endfor %}
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %} text under the loss mask
    {{ expr }}                               literals, +, ==, !=, and, or, not, (...),
                                             filters: upper, lower, trim, raw

Texts and roles of messages are escaped: a backslash goes before every backslash and before
every character with which a control string begins. So no control string can arise inside a
text or over its edges, and :func:`unescape` gives the text back exactly.

Defined cases: null text or role: empty; null turn sorts first; turns that tie are ordered by
role, then text; repeated rows are repeated turns; a null conversation id is a conversation;
an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% control '[INST]' '[/INST]' '[OUT]' '</s>' '[ROLE]' '[TEXT]' '[/ROLE]' %}"
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text }}[/INST]"
    "{% elif m.role == 'assistant' %}[OUT]{% generation %}{{ m.text }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role }}[TEXT]{{ m.text }}[/ROLE]{% endif %}"
    "{% endfor %}"
)


# ---- syntax tree --------------------------------------------------------------------------
@dataclass
class Text:
    value: str


@dataclass
class Emit:
    expr: tuple


@dataclass
class If:
    branches: list  # (condition or None, body)


@dataclass
class For:
    name: str
    body: list


@dataclass
class Generation:
    body: list


@dataclass
class Template:
    body: list
    controls: list = field(default_factory=list)


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}", re.S)
_LEXEME = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[().|+]))")
_FILTERS: dict[str, Callable[[str], str]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip}


def _lex(source: str) -> list[str]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        found = _LEXEME.match(source, at)
        if not found:
            raise TemplateError(f"unexpected {source[at:]!r}")
        out.append(found.group().strip())
        at = found.end()
    return out


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, atom."""

    def __init__(self, source: str):
        self.items, self.at = _lex(source), 0

    def whole(self) -> tuple:
        tree = self.either()
        if self.at != len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at]!r}")
        return tree

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def take(self, *wanted: str) -> str:
        item = self.peek()
        if not item or (wanted and item not in wanted):
            raise TemplateError(f"expected {wanted or 'more'}, found {item!r}")
        self.at += 1
        return item

    def either(self) -> tuple:
        left = self.both()
        while self.peek() == "or":
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.peek() == "and":
            self.take()
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        left = self.total()
        if self.peek() in ("==", "!="):
            return (self.take(), left, self.total())
        return left

    def total(self) -> tuple:
        left = self.filtered()
        while self.peek() == "+":
            self.take()
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.atom()
        while self.peek() == "|":
            self.take()
            name = self.take()
            if name != "raw" and name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            left = ("filter", name, left)
        return left

    def atom(self) -> tuple:
        item = self.take()
        if item == "(":
            inner = self.either()
            self.take(")")
            return inner
        if item.startswith("'"):
            return ("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), item[1:-1], flags=re.S))
        if item in ("true", "false"):
            return ("literal", item == "true")
        if not item[0].isalpha():
            raise TemplateError(f"unexpected {item!r}")
        self.take(".")
        name = self.take()
        if name not in (("first", "last", "index") if item == "loop" else ("role", "text")):
            raise TemplateError(f"{item}.{name} is not open to templates")
        return ("get", item, name)


def parse(source: str) -> Template:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for tag in _TAG.finditer(source):
        if tag.start() > at:
            pieces.append(("text", source[at: tag.start()]))
        pieces.append(("tag", tag[1]) if tag[1] is not None else ("emit", tag[2]))
        at = tag.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    template = Template([])
    place = 0

    def block(ends: tuple[str, ...]) -> list:
        nonlocal place
        body: list = []
        while place < len(pieces):
            kind, value = pieces[place]
            word = value.split()[0] if kind == "tag" and value else ""
            if kind == "tag" and word in ends:
                return body
            place += 1
            if kind == "text":
                body.append(Text(value))
            elif kind == "emit":
                body.append(Emit(_Expression(value).whole()))
            elif word == "control":
                template.controls += [_Expression(x).whole()[1] for x in _lex(value[len(word):])]
            elif word == "for":
                made = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+messages", value)
                if not made or made[1] == "loop":
                    raise TemplateError(f"only 'for x in messages', not {value!r}")
                body.append(For(made[1], block(("endfor",))))
                place += 1
            elif word == "if":
                branches = [(_Expression(value[2:]).whole(), block(("elif", "else", "endif")))]
                while place < len(pieces) and not pieces[place][1].startswith("endif"):
                    head = pieces[place][1]
                    place += 1
                    branches.append((_Expression(head[4:]).whole() if head.startswith("elif") else None, block(("elif", "else", "endif"))))
                body.append(If(branches))
                place += 1
            elif word == "generation":
                body.append(Generation(block(("endgeneration",))))
                place += 1
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return body

    template.body = block(())
    if not template.controls:
        raise TemplateError("a template names its control strings")
    return template


# ---- constant folding ---------------------------------------------------------------------
def fold_expression(tree: tuple) -> tuple:
    """The tree with every constant part replaced by its value."""
    kind, *parts = tree
    if kind in ("literal", "get"):
        return tree
    if kind == "filter":
        name, inner = parts[0], fold_expression(parts[1])
        return ("literal", _FILTERS[name](inner[1])) if inner[0] == "literal" and name != "raw" else ("filter", name, inner)
    parts = [fold_expression(x) for x in parts]
    if kind in ("and", "or") and parts[0][0] == "literal":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(x[0] == "literal" for x in parts):
        values = [x[1] for x in parts]
        return ("literal", {"+": lambda: values[0] + values[1], "==": lambda: values[0] == values[1], "!=": lambda: values[0] != values[1], "not": lambda: not values[0], "and": lambda: values[0] and values[1], "or": lambda: values[0] or values[1]}[kind]())
    return (kind, *parts)


def fold(body: list) -> list:
    """Folds expressions, drops branches that cannot run and joins neighbouring text."""
    out: list = []
    for node in body:
        if isinstance(node, Emit):
            expr = fold_expression(node.expr)
            made: list = [Text(str(expr[1]))] if expr[0] == "literal" else [Emit(expr)]
        elif isinstance(node, If):
            branches: list = []
            for condition, inner in node.branches:
                condition = fold_expression(condition) if condition else None
                if condition is None or condition[0] == "literal":
                    if condition is None or condition[1]:
                        branches.append((None, fold(inner)))
                        break
                    continue
                branches.append((condition, fold(inner)))
            made = branches[0][1] if branches and branches[0][0] is None else [If(branches)] if branches else []
        elif isinstance(node, For):
            made = [For(node.name, fold(node.body))]
        elif isinstance(node, Generation):
            made = [Generation(fold(node.body))]
        else:
            made = [node]
        for x in made:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + x.value)
            elif not isinstance(x, Text) or x.value:
                out.append(x)
    return out


# ---- escaping -----------------------------------------------------------------------------
def escaper(controls: Iterable[str]) -> Callable[[str], str]:
    firsts = "".join(sorted({re.escape(x[0]) for x in controls} | {re.escape("\\")}))
    pattern = re.compile(f"([{firsts}])")
    return lambda text: pattern.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


# ---- closures -----------------------------------------------------------------------------
class Sink:
    """Output of a rendering: parts, and loss spans as code points of the whole output."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = self.at = 0
        self.spans: list[tuple[int, int]] = []
        self.opened = -1

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)
        self.at += len(text)

    def cut(self) -> tuple[str, list[tuple[int, int]]]:
        out = "".join(self.parts), self.spans
        self.parts, self.spans, self.size = [], [], 0
        return out


def _value(tree: tuple, escape: Callable[[str], str]) -> Callable[[dict], object]:
    kind, *parts = tree
    if kind == "literal":
        return lambda env, v=parts[0]: v
    if kind == "get":
        return lambda env, of=parts[0], name=parts[1]: env[of][name]
    if kind == "filter":
        inner = _value(parts[1], escape)
        return inner if parts[0] == "raw" else lambda env, f=_FILTERS[parts[0]]: f(inner(env))
    a, b = _value(parts[0], escape), _value(parts[-1], escape)
    return {"+": lambda env: str(a(env)) + str(b(env)), "==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "not": lambda env: not a(env), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env)}[kind]


def _raw(tree: tuple) -> bool:
    return tree[0] == "filter" and (tree[1] == "raw" or _raw(tree[2]))


def _closure(body: list, escape: Callable[[str], str]) -> Callable[[dict, Sink], Iterator[None]]:
    """A generator that renders ``body``; it yields after every turn, so that output can leave."""
    steps = []
    for node in body:
        if isinstance(node, Text):
            def step(env, sink, v=node.value):
                sink.write(v)
                return ()
        elif isinstance(node, Emit):
            def step(env, sink, v=_value(node.expr, escape), e=(lambda x: x) if _raw(node.expr) else escape):
                sink.write(e(str(v(env))))
                return ()
        elif isinstance(node, If):
            def step(env, sink, arms=[(_value(c, escape) if c else None, _closure(inner, escape)) for c, inner in node.branches]):
                return next((run(env, sink) for test, run in arms if test is None or test(env)), ())
        elif isinstance(node, Generation):
            def step(env, sink, run=_closure(node.body, escape)):
                begin = sink.at
                yield from run(env, sink)
                sink.spans.append((begin, sink.at))
        else:
            def step(env, sink, name=node.name, run=_closure(node.body, escape)):
                ahead = iter(env["messages"])
                now = next(ahead, None)
                index = 0
                while now is not None:
                    after = next(ahead, None)
                    index += 1
                    yield from run({**env, name: now, "loop": {"first": index == 1, "last": after is None, "index": index}}, sink)
                    yield
                    now = after
        steps.append(step)

    def run(env: dict, sink: Sink) -> Iterator[None]:
        for step in steps:
            yield from step(env, sink)

    return run


def compile_template(source: str) -> Callable[[Iterable[dict], int], Iterator[tuple[str, list[tuple[int, int]]]]]:
    """``render(messages, part_chars)`` gives the output in parts of whole turns, each with the
    loss spans that ended in it."""
    template = parse(source)
    run = _closure(fold(template.body), escaper(template.controls))

    def render(messages: Iterable[dict], part_chars: int = 1 << 16) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        sink = Sink()
        for _ in run({"messages": messages}, sink):
            if sink.size >= part_chars:
                yield sink.cut()
        yield sink.cut()

    return render


# ---- Spark --------------------------------------------------------------------------------
PARTS = "conv_id long, part long, start long, formatted string, loss_spans array<struct<start:long,end:long>>"


def _runs(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Neighbouring rows with one first value, as a lazy stream for each."""
    row = next(rows, None)
    while row is not None:
        key, held = row[0], [row]

        def group(key=key, held=held):
            now = held[0]
            while now is not None and now[0] == key:
                yield now
                now = held[0] = next(rows, None)

        stream = group()
        yield key, stream
        for _ in stream:
            pass
        row = held[0]


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = 1 << 16) -> DataFrame:
    """Rows (conv_id, part, start, formatted, loss_spans): the formatted text of a conversation
    is its parts in order; ``start`` is a part's first code point and spans count from the
    conversation's first. Turns of one conversation are read in order by one task, as a stream."""
    compile_template(template)  # a faulty template fails here, not in a task

    def rows(batches):
        render = compile_template(template)
        out: list = []
        held = 0
        for conv, turns in _grouped(_runs(batches, ["conv_id", "role", "text"])):
            at = 0
            for part, (text, spans) in enumerate(render(({"role": r or "", "text": t or ""} for _, r, t in turns), part_chars)):
                out.append((conv, part, at, text, [{"start": a, "end": b} for a, b in spans]))
                at += len(text)
                held += len(text)
                if held >= 1 << 21:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.string(), span])], ["conv_id", "part", "start", "formatted", "loss_spans"])

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(rows, PARTS)


#: How the reader finds turns in text of TEMPLATE: opening mark, role, closing mark.
_MARK = re.compile(r"\\.|\[INST\]|\[/INST\]|\[OUT\]|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]", re.S)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a part formatted with TEMPLATE."""
    role, begin = "", 0
    for mark in _MARK.finditer(text):
        sign = mark.group()
        if sign[0] == "\\":
            continue
        inner = unescape(text[begin: mark.start()])
        begin = mark.end()
        if sign in ("[/INST]", "</s>", "[/ROLE]"):
            yield {"[/INST]": "user", "</s>": "assistant"}.get(sign, role), inner
        elif sign == "[TEXT]":
            role = inner


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Reads formatted parts back: one row per conversation with the number of turns, the digest
    of its turns, and the length and digest of the unescaped text under the loss mask.
    ``in_order``: the parts come straight from :func:`format_conversations`."""

    def rows(batches):
        out = []
        for conv, parts in _grouped(_runs(batches, ["conv_id", "start", "formatted", "loss_spans"])):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = size = 0
            for _, start, text, spans in parts:
                for role, said in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] - start: span["end"] - start])
                    loss.update(said.encode())
                    chars += len(said)
                size += len(text)
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(rows, DIGESTS)


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Contract query: all conversations, and conversation -7 with control strings in its texts."""
    said = F.lit("</s>[INST] ok [/INST]")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversation_digests(format_conversations(table.unionByName(extra)), in_order=True)


#: Per turn: code points of the role's and the text's escaped form and of the template's marks.
ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g')) as text_chars,
         length(role) + length(regexp_replace(role, '[^\\\[<]', '', 'g')) as role_chars from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(case role when 'user' then text_chars + 13 when 'assistant' then text_chars + 9
                else role_chars + text_chars + 19 end) as bigint) as formatted_chars
from e group by conv_id
"""

"""Chat formatting by schema fingerprints, in DataFrame functions only.

Conversations come in many layouts: rows by turn, message lists, prompt and completion, instruction, input
and output. A record is a VARIANT. Its nested field paths (``messages[].role``), cut to those that some
mapping knows, are sorted and hashed; the hash selects the declarative mapping (``LAYOUTS``) that turns the
record into canonical turns (turn, role, text). A mapping is data: paths that must be there, paths that may
be, and where roles and texts are found. Records whose paths no mapping fits keep their fingerprint, with
layout and turns NULL, so that a mapping can be added (``layouts``); none is guessed.

``form`` writes one text for each conversation::

    <turn ROLE>
    TEXT
    </turn>

The role is percent-encoded. Within a text, a control string (``<turn`` or ``</turn``) with any number of
backslashes in front gets one more; reading takes one away. Nothing else in a text changes, and a marker,
which stands at the start of a line, is never escaped, so ``read`` restores every text exactly. The loss mask
has one entry for each turn: how many code points of the output are skipped, trained on, skipped again.
It needs no running sum over a conversation, and reading it is linear in the text.

Scale: one pass over the records and one exchange of the texts by conversation. A conversation is one row
of the output, so its own text has to fit there; conversations share nothing else.

Cases: a NULL text or role is empty. Turns are ordered by number (NULL first), then role and text; repeated rows
stay, each as a turn. A NULL id is an id like any other. A part of a whole record that is absent or NULL
(such as ``input``) makes no turn, an empty one does. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence
from itertools import chain, combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Field(NamedTuple):
    """A turn from one or several fields of the record; what is there is joined by an empty line."""
    role: str
    paths: tuple[str, ...]


class Items(NamedTuple):
    """A turn from every element of an array of objects."""
    array: str
    role: str
    text: str
    roles: dict[str, str] = {}


class Row(NamedTuple):
    """The record is one turn itself, with its number."""
    turn: str
    role: str
    text: str


class Layout(NamedTuple):
    name: str
    required: tuple[str, ...]
    parts: tuple[Field | Items | Row, ...]
    optional: tuple[str, ...] = ()


_SYSTEM = Field("system", ("system",))
_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
LAYOUTS = (
    Layout("turn_rows", ("turn", "role", "text"), (Row("turn", "role", "text"),)),
    Layout("messages", ("messages[].role", "messages[].content"), (_SYSTEM, Items("messages", "role", "content")), ("system",)),
    Layout("speakers", ("conversations[].from", "conversations[].value"),
           (_SYSTEM, Items("conversations", "from", "value", _NAMES)), ("system",)),
    Layout("dialogue", ("dialogue[].speaker", "dialogue[].utterance"), (Items("dialogue", "speaker", "utterance", _NAMES),)),
    Layout("instruction", ("instruction", "output"),
           (_SYSTEM, Field("user", ("instruction", "input")), Field("assistant", ("output",))), ("input", "system")),
    Layout("completion", ("prompt", "completion"), (_SYSTEM, Field("user", ("prompt",)), Field("assistant", ("completion",))), ("system",)),
    Layout("response", ("prompt", "response"), (_SYSTEM, Field("user", ("prompt",)), Field("assistant", ("response",))), ("system",)),
    Layout("question", ("question", "answer"),
           (_SYSTEM, Field("user", ("context", "question")), Field("assistant", ("answer",))), ("context", "system")),
    Layout("message_completion", ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content", "prompt", "completion"),
           (Items("prompt", "role", "content"), Items("completion", "role", "content"))),
)
TRAINED = ("assistant",)
CONTROL = r"</?turn"
END = "\n</turn>\n"


def records(table: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, record) of a typed table; ``columns`` are the fields that a mapping is to see."""
    return table.select(F.col(f"`{id_col}`").alias("id"), F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("record"))


def field_paths(record: Column) -> Column:
    """Nested field paths of a VARIANT, sorted: ``a``, ``a.b``, ``a[].b``; names other than words in backticks. One fold
    over the parts of its schema string, with a stack of the objects and arrays that are open."""
    text = F.array(F.lit("")).cast("array<string>")
    start = F.struct(text.alias("open"), F.lit("").alias("at"), F.slice(text, 1, 0).alias("paths"))
    parts = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(?:`[^`]*(?:``[^`]*)*`|\w+): |OBJECT<|ARRAY<|>"), F.lit(0))

    def step(state: Column, part: Column) -> Column:
        top = F.element_at(state["open"], -1)
        name = F.substr(part, F.lit(1), F.length(part) - 2)
        path = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        closed = F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(1)))
        opened = F.concat(state["open"], F.array(state["at"]))
        return (F.when(part == "OBJECT<", F.struct(opened.alias("open"), state["at"].alias("at"), state["paths"].alias("paths")))
                .when(part == "ARRAY<", F.struct(opened.alias("open"), F.concat(state["at"], F.lit("[]")).alias("at"), state["paths"].alias("paths")))
                .when(part == ">", F.struct(closed.alias("open"), top.alias("at"), state["paths"].alias("paths")))
                .otherwise(F.struct(state["open"].alias("open"), path.alias("at"), F.concat(state["paths"], F.array(path)).alias("paths"))))

    return F.array_sort(F.array_distinct(F.aggregate(parts, start, step, lambda s: s["paths"])))


def _hash(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _known(layouts: Sequence[Layout]) -> list[str]:
    return sorted({p for x in layouts for p in (*x.required, *x.optional)})


def fingerprints(layouts: Sequence[Layout]) -> dict[str, int]:
    """Fingerprint -> number of the layout: one for each choice of a layout's optional paths."""
    out: dict[str, int] = {}
    for i, x in enumerate(layouts):
        for chosen in chain.from_iterable(combinations(x.optional, k) for k in range(len(x.optional) + 1)):
            if out.setdefault(_hash((*x.required, *chosen)), i) != i:
                raise ValueError(f"layouts {layouts[out[_hash((*x.required, *chosen))]].name} and {x.name} have the same paths")
    return out


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of those field paths of a record that some layout names."""
    known = F.array(*[F.lit(p) for p in _known(layouts)])
    return F.sha2(F.array_join(F.array_intersect(field_paths(record), known), "\n").cast("binary"), 256)


def _text(value: Column) -> Column:
    """Text of a VARIANT: a string as it is, a list of parts by the text of each, a line end between."""
    parts = F.try_variant_get(value, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(
        F.try_variant_get(p, "$.text", "string"), F.when(~F.schema_of_variant(p).startswith("OBJECT"), F.try_variant_get(p, "$", "string")),
        F.lit(""))), "\n")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), joined).otherwise(F.try_variant_get(value, "$", "string"))


def _turns_of(record: Column, part: Field | Items | Row) -> Column:
    """The part's turns as array<struct<turn, role, text>>; empty where it is absent."""
    at = lambda x, path, kind: F.try_variant_get(x, f"$.{path}", kind)
    turn = lambda number, role, text: F.struct(number.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("bigint")
    if isinstance(part, Row):
        return F.array(turn(at(record, part.turn, "bigint"), F.coalesce(at(record, part.role, "string"), F.lit("")),
                            F.coalesce(at(record, part.text, "string"), F.lit(""))))
    if isinstance(part, Items):
        def one(x: Column) -> Column:
            role = F.coalesce(at(x, part.role, "string"), F.lit(""))
            if part.roles:
                names = F.create_map(*[F.lit(y) for pair in part.roles.items() for y in pair])
                role = F.coalesce(F.try_element_at(names, F.lower(role)), role)
            return turn(none, role, F.coalesce(_text(at(x, part.text, "variant")), F.lit("")))
        return F.coalesce(F.transform(at(record, part.array, "array<variant>"), one), F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))
    texts = F.filter(F.array(*[_text(at(record, p, "variant")) for p in part.paths]), lambda x: x.isNotNull())
    made = F.array(turn(none, F.lit(part.role), F.array_join(texts, "\n\n")))
    return F.filter(made, lambda _: F.size(texts) > 0)


def convert(rows: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(id, record) -> id, fingerprint, layout, turns. Turns of whole records are numbered from 0."""
    table = fingerprints(layouts)
    choose = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    d = rows.select("id", "record", fingerprint(F.col("record"), layouts).alias("fingerprint")) \
        .withColumn("_layout", F.try_element_at(choose, F.col("fingerprint")))
    turns, name = F.lit(None), F.lit(None).cast("string")
    for i, x in enumerate(layouts):
        own = functools.reduce(F.concat, [_turns_of(F.col("record"), p) for p in x.parts])
        if not any(isinstance(p, Row) for p in x.parts):
            own = F.transform(own, lambda t, at: F.struct(at.cast("bigint").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
        turns, name = F.when(F.col("_layout") == i, own).otherwise(turns), F.when(F.col("_layout") == i, F.lit(x.name)).otherwise(name)
    return d.select("id", "fingerprint", name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*+{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+{CONTROL})", "$1")


def form(converted: DataFrame, trained: Sequence[str] = TRAINED) -> DataFrame:
    """id, formatted, loss_mask (array of before, loss, after: code points) of each conversation, whose turns may
    come from several records."""
    whole = converted.select("id", F.inline("turns")).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def segment(t: Column) -> Column:
        return F.struct(F.concat(F.lit("<turn "), F.url_encode(t["role"]), F.lit(">\n")).alias("head"), escape(t["text"]).alias("text"),
                        t["role"].isin(*trained).alias("trained"))

    def mask(s: Column) -> Column:
        head, text = F.length(s["head"]), F.length(s["text"])
        return F.when(s["trained"], F.struct(head.alias("before"), text.alias("loss"), F.lit(len(END)).alias("after"))) \
            .otherwise(F.struct((head + text + len(END)).alias("before"), F.lit(0).alias("loss"), F.lit(0).alias("after")))

    cut = whole.select("id", F.transform("turns", segment).alias("s"))
    return cut.select("id", F.array_join(F.transform("s", lambda s: F.concat(s["head"], s["text"], F.lit(END))), "").alias("formatted"),
                      F.transform("s", mask).alias("loss_mask"))


def read(formed: DataFrame) -> DataFrame:
    """id, turns (role, text, loss: the text under the mask, unescaped; NULL where nothing is trained on) and
    formatted, from ``form``'s output alone."""
    segments = F.split("formatted", END, -1)
    segments = F.slice(segments, 1, F.size(segments) - 1)

    def turn(segment: Column, mask: Column) -> Column:
        head = F.substring_index(segment, ">\n", 1)
        text = F.substr(segment, F.length(head) + 3)
        under = F.when(mask["loss"] + mask["after"] > 0, unescape(F.substr(segment, mask["before"] + 1, mask["loss"])))
        return F.struct(F.url_decode(F.substr(head, F.lit(7))).alias("role"), unescape(text).alias("text"), under.alias("loss"))

    return formed.select("id", F.zip_with(segments, "loss_mask", turn).alias("turns"), "formatted")


def digest(back: DataFrame) -> DataFrame:
    """The contract's columns of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return back.select("id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars")) \
        .select(F.col("id").alias("conv_id"), "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
                F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: Conversation -7 of the query, a record of another layout than the table's.
PROBE_ID = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


def sql(trained: Sequence[str] = TRAINED) -> str:
    """The digests by plain aggregation over the turns; the length of the output from its parts."""
    roles = ", ".join(f"'{r}'" for r in trained)
    text = PROBE_TEXT.replace("'", "''")
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT {PROBE_ID}, 0, 'user', '{text}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{text}')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role IN ({roles}) THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role IN ({roles}) THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
           CAST(sum(length('<turn >') + 1 + length(url_encode(role)) + length(text) + len(regexp_extract_all(text, '</?turn')) + length('</turn>') + 2) AS BIGINT)
             AS formatted_chars
    FROM t GROUP BY conv_id"""

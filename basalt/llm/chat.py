"""Chat formatting: a finite-state machine checks the order of roles, a declarative template emits segments.

Built-in functions only. One conversation becomes one row, since its formatted text is one string.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How one role is written: control strings around the text, and whether the text is learned."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, the turns that may follow each state, and the form of roles that the template doesn't know.

    Every control string has to start with < or [, since these are what escaping removes from texts.
    """

    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>\n"),
            "user": Turn("[INST]", "[/INST]\n"),
            "assistant": Turn("<s>", "</s>\n", loss=True),
        }
    )
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)
    other: Turn = Turn("[ROLE:{role}]", "[/ROLE]\n")

    def __post_init__(self) -> None:
        for name, turn in [*self.roles.items(), ("other", self.other)]:
            for what, control in (("open", turn.open), ("close", turn.close)):
                if control[:1] not in ("<", "["):
                    raise ValueError(f"{name}'s {what} has to start with < or [, which texts are freed from: {control!r}")
        openers = [t.open for t in self.roles.values()]
        if len(set(openers)) < len(openers):
            raise ValueError("two roles have one opening")
        if self.other.open.count("{role}") != 1:
            raise ValueError("the opening of other roles has to hold {role} once")


DEFAULT = Template()
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(text: Column) -> Column:
    """Take < and [ (and so every control string) out of a text; unescape() gives the text back."""
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _by_role(role: Column, template: Template, of) -> Column:
    out = None
    for name, turn in template.roles.items():
        out = (F if out is None else out).when(role == name, F.lit(of(turn)))
    return out


def format_chats(
    df: DataFrame,
    template: Template = DEFAULT,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, first_bad_turn, segments, formatted.

    segments is an array of (text, loss); formatted is their concatenation. valid says that the machine
    accepts the order of roles and ends in a final state; first_bad_turn is the index of the first turn it
    refuses (-1: none); after a refused turn it goes on from that turn's role. Turns are ordered by turn,
    then role, then text; a null turn comes first; repeated rows stay repeated. A null text or role is an
    empty one. A null conv_id is a conversation of its own. An empty table gives no rows; other columns
    are ignored.
    """
    rows = df.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    moves = F.array(*[F.lit(f"{a}>{b}") for a, then in template.follows.items() for b in then])

    def step(acc: Column, t: Column) -> Column:
        ok = F.array_contains(moves, F.concat(acc["state"], F.lit(">"), t["role"]))
        return F.struct(
            t["role"].alias("state"),
            F.when((acc["bad"] < 0) & ~ok, acc["i"]).otherwise(acc["bad"]).alias("bad"),
            (acc["i"] + 1).alias("i"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("i"))

    def three(t: Column) -> Column:
        opener = F.coalesce(
            _by_role(t["role"], template, lambda x: x.open),
            F.concat(F.lit(template.other.open.split("{role}")[0]), escape(t["role"]), F.lit(template.other.open.split("{role}")[1])),
        )
        closer = F.coalesce(_by_role(t["role"], template, lambda x: x.close), F.lit(template.other.close))
        loss = F.coalesce(_by_role(t["role"], template, lambda x: x.loss), F.lit(template.other.loss))
        seg = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(seg(opener, F.lit(False)), seg(escape(t["text"]), loss), seg(closer, F.lit(False)))

    return (
        turns.withColumn("end", F.aggregate("turns", start, step))
        .withColumn("segments", F.flatten(F.transform("turns", three)))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            ((F.col("end.bad") < 0) & F.col("end.state").isin(*template.final)).alias("valid"),
            F.col("end.bad").alias("first_bad_turn"),
            "segments",
            F.array_join(F.col("segments.text"), "").alias("formatted"),
        )
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The (role, text) pairs that a formatted text holds, unescaped."""
    head, tail = template.other.open.split("{role}")
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c not in " \n<>:/" else c for c in s)
    opener = "|".join([quote(t.open) for t in template.roles.values()] + [quote(head) + r"[^<\[\]]*" + quote(tail)])
    pattern = F.lit(f"({opener})([^<\\[]*)")
    roles = F.transform(
        F.regexp_extract_all(formatted, pattern, F.lit(1)),
        lambda o: F.coalesce(
            *[F.when(o == t.open, F.lit(name)) for name, t in template.roles.items()],
            unescape(F.substring(o, len(head) + 1, F.length(o) - len(head) - len(tail))),
        ),
    )
    texts = F.transform(F.regexp_extract_all(formatted, pattern, F.lit(2)), unescape)
    return F.zip_with(roles, texts, lambda r, t: F.struct(r.alias("role"), t.alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")

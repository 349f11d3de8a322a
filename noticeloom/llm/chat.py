"""Chat formatting: turns checked by a finite-state machine and written with a declarative template."""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Strings with a meaning in common chat formats; inside texts and roles they are escaped.
CONTROLS = (
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles the loss counts, and which role may follow which.

    A turn is ``begin``, role, ``middle``, text, ``end``. ``follows`` gives for every state the
    roles that may come next; the state is the last role, at first ``""``. A conversation is valid
    when every step is allowed and the last role is in ``final``. ``begin`` and ``controls`` are
    escaped in texts, and ``middle`` in roles as well; marks that cannot be read back are refused.
    """

    begin: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self) -> None:
        _checked(self)


def _codes(template: Template) -> dict[str, str]:
    """The sign that stands, after a backslash, for a first character of a protected string."""
    marks = _protected(template, True)
    free = [sign for sign in string.digits + string.ascii_letters if not any(sign in mark for mark in [*marks, template.end])]
    return dict(zip(["\\", *sorted({mark[0] for mark in marks})], free, strict=False))


def _protected(template: Template, role: bool) -> list[str]:
    """Strings that may not stand in a text, or a role, longest first; a role ends at the middle mark."""
    marks = {template.begin, *template.controls, *([template.middle] if role else [])}
    return sorted(marks, key=lambda mark: (-len(mark), mark))


def _checked(template: Template) -> None:
    """Refuse what cannot be read back: a mark that could also arise across the seam of two parts."""
    begin, middle, end = template.begin, template.middle, template.end
    marks = _protected(template, True)
    if not all(marks) or any("\\" in mark for mark in [*marks, end]):
        raise ValueError("marks and control strings are not empty and hold no backslash")
    if len(_codes(template)) <= len({mark[0] for mark in marks}):
        raise ValueError("too many different first characters of marks and control strings")
    for mark, after in ((begin, middle), (begin, end + begin), (middle, middle)):
        for cut in range(1, len(mark)):
            if after.startswith(mark[cut:]) or mark[cut:].startswith(after):
                raise ValueError(f"{mark!r} could arise where a text meets {after!r}")
    if begin in middle or begin in end:
        raise ValueError(f"{begin!r} is part of another mark")
    for before in (begin, middle, end):
        if any(before.endswith(begin[:cut]) for cut in range(1, len(begin))) or begin in before[1:] + begin[:-1]:
            raise ValueError(f"{begin!r} could arise where {before!r} meets a text")


def escape(text: Column, template: Template, role: bool = False) -> Column:
    """Take the first character out of every protected string; reversible by ``unescape``."""
    codes = _codes(template)
    out = F.replace(text, F.lit("\\"), F.lit("\\" + codes["\\"]))
    for mark in _protected(template, role):
        out = F.replace(out, F.lit(mark), F.lit("\\" + codes[mark[0]] + mark[1:]))
    return out


def unescape(text: Column, template: Template | None = None) -> Column:
    codes = _codes(template or Template())
    for plain, code in reversed(codes.items()):
        text = F.replace(text, F.lit("\\" + code), F.lit(plain))
    return text


def check_order(roles: Column, template: Template) -> Column:
    """Struct (valid, state, step): the machine's verdict, its last state, the first bad step or null."""

    def allowed(state: Column, role: Column) -> Column:
        rules = [(state == before) & role.isin(*after) for before, after in template.follows.items() if after]
        return reduce(lambda a, b: a | b, rules, F.lit(False))

    start = F.struct(
        F.lit("").alias("state"), F.lit(0).alias("step"), F.lit(None).cast("int").alias("bad")
    )

    def move(at: Column, role: Column) -> Column:
        wrong = F.when(at["bad"].isNull() & ~allowed(at["state"], role), at["step"]).otherwise(at["bad"])
        return F.struct(role.alias("state"), (at["step"] + 1).alias("step"), wrong.alias("bad"))

    def verdict(at: Column) -> Column:
        good = at["bad"].isNull() & at["state"].isin(*template.final)
        return F.struct(good.alias("valid"), at["state"].alias("state"), at["bad"].alias("step"))

    return F.aggregate(roles, start, move, verdict)


def _turn_segments(turn: Column, template: Template) -> Column:
    """The turn as text segments with a loss flag each."""
    head = F.concat(F.lit(template.begin), escape(turn["role"], template, role=True), F.lit(template.middle))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(
        part(head, F.lit(False)),
        part(escape(turn["text"], template), turn["role"].isin(*template.loss_roles)),
        part(F.lit(template.end), F.lit(False)),
    )


def format_chats(
    turns: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, bad_step, segments, formatted.

    Turns are put in order by turn, then role, then text (null first), so repeated or tied rows
    have a place; a null role or text is empty. All conversations are written; ``valid`` says
    whether the machine accepts the roles, ``bad_step`` names the first turn, from 0, that it does
    not. ``segments`` holds texts with loss flags; ``formatted`` is all of them in a row. A null
    conversation id is a conversation of its own. Other columns are not read.
    """
    template = template or Template()
    text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    row = F.struct(
        F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")
    )
    gathered = turns.groupBy(F.col(f"`{conv_col}`").alias("conv_id")).agg(
        F.array_sort(F.collect_list(row)).alias("turns")
    )
    segments = F.flatten(F.transform("turns", lambda turn: _turn_segments(turn, template)))
    cut = gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        check_order(F.transform("turns", lambda turn: turn["role"]), template).alias("order"),
        segments.alias("segments"),
    )
    return cut.select(
        "conv_id",
        "n_turns",
        F.col("order.valid").alias("valid"),
        F.col("order.step").alias("bad_step"),
        "segments",
        F.array_join(F.transform("segments", lambda part: part["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template) -> Column:
    """Array of struct (role, text): the turns of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, _quoted(template.begin)), lambda _, at: at > 0)

    def turn(piece: Column) -> Column:
        cut = F.length(F.substring_index(piece, template.middle, 1))
        rest = F.substr(piece, cut + 1 + len(template.middle))
        text = F.left(rest, F.length(rest) - len(template.end))
        return F.struct(
            unescape(F.left(piece, cut), template).alias("role"), unescape(text, template).alias("text")
        )

    return F.transform(pieces, turn)


def read_loss(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.filter(segments, lambda part: part["loss"])
    return F.array_join(F.transform(parts, lambda part: unescape(part["text"], template)), "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"

"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines by Viterbi.

A transcript is plain text whose lines belong to turns. The hidden state of a line is its role and
whether it begins a turn; its observations are a speaker marker at its start (a role's name or alias, or
the first, second or a further name of a transcript that names its speakers otherwise), the marker's shape
(a name and a sign, a bracket, a heading, a tag, a time before it), whether it is written as the
transcript's first one is, blankness, length, a closing question mark and whether it opens like an
instruction. Emission and transition chances are counted, with smoothing, over transcripts made
of known conversations in several marker styles, whose texts hold lists, code and lines that look like
markers. Viterbi finds the most likely states; turns are then rendered in one canonical form.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.llm.lineage import cut

ROLES = ("system", "user", "assistant")
#: How transcripts call each role.
ALIASES = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompter", "you", "utilisateur", "usuario", "benutzer", "nutzer"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "gpt", "chatgpt", "chatbot", "assistente", "asistente", "assistent"),
}
_ROLE_OF = {alias: role for role, names in ALIASES.items() for alias in names}
#: Verbs that may stand between a speaker's name and the colon.
_SAYS = ("said", "says", "asked", "replied", "answered", "wrote")
_NAME = r"[^\W\d_][\w.'-]{0,23}(?: [A-Z][\w.'-]{0,23})?"
_TIME = r"[\[(]?\d{1,2}:\d\d(?::\d\d)?(?: ?[AaPp][Mm])?[\])]?(?: ?[-,–])? "
_MARKER = re.compile(
    rf"\s*(?:<\|(?:im_start\|>)?\s*(?P<tag>[A-Za-z]+)\s*(?:\|>)?"
    rf"|<(?P<xml>[A-Za-z]+)>"
    rf"|(?P<hashes>#{{1,6}}) +(?P<heading>{_NAME})\s*$"
    rf"|(?P<time>{_TIME})?(?P<open>[\[(#>*_]*)(?P<gap> *)(?P<name>{_NAME}?)(?P<says> (?:{'|'.join(_SAYS)}))?(?P<close> ?[\])*_]*)(?P<sep>:|>|\]|-(?=\s))(?P<after>[*_]*))"
)
#: What ends a turn in some transcripts, at its last line's end.
_CLOSING = re.compile(r"\s*(?:</(?P<xml>[A-Za-z]+)>|<\|(?:end|im_end|eot|endoftext)\|>)\s*$")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
IMPOSSIBLE = -1e9


@dataclass(frozen=True)
class Marker:
    name: str  # lower-cased
    style: str  # all but the name: marks around it, its case and whether it is one letter
    end: int  # where the text after it begins
    shape: str  # sign, bracket, heading, tag or time


def marker(line: str) -> Marker | None:
    """The speaker marker that a line may begin with. Marks after the separator belong to it only where
    the same marks open it, so Markdown in the text after it stays. A tag such as ``<b>`` or a heading is
    one only where it names a role."""
    m = _MARKER.match(line)
    if not m:
        return None
    name = m["tag"] or m["xml"] or m["heading"] or m["name"]
    # A short name in capitals, such as AI, is a title as others are.
    case = "one" if len(name) == 1 else "upper" if name.isupper() and len(name) > 3 else "title" if name[0].isupper() else "lower"
    end, shape = m.end(), "tag"
    if m["tag"]:
        style = f"<|{'im_start' if 'im_start' in m[0] else ''} {case}"
    elif m["xml"] or m["heading"]:
        if name.lower() not in _ROLE_OF:
            return None
        style, shape = (f"<> {case}", "tag") if m["xml"] else (f"{m['hashes']} {case}", "heading")
    else:
        closes = bool(m["after"]) and m["open"].endswith(m["after"])
        end = m.end() if closes else m.end("sep")
        style = f"{'time ' if m['time'] else ''}{m['open']}{m['gap']}{m['says'] or ''}{m['close']}{m['sep']}{m['after'] if closes else ''} {case}"
        shape = "time" if m["time"] else "heading" if m["open"].startswith("#") else "bracket" if m["open"] or m["sep"] != ":" else "sign"
    while end < len(line) and line[end] in " \t":
        end += 1
    return Marker(name.lower(), style, end, shape)


@dataclass(frozen=True)
class Context:
    """What all lines of a transcript share: how its first line's marker is written (or else the first that
    names a role), and the names that speak without naming a role, by the order in which they come in."""

    style: str = ""
    names: tuple[str, ...] = ()
    missing: str = ""  # the role of the only such name, where all other speakers bear roles' names


#: Speakers told apart by name; those past the last are taken for text.
SPEAKERS = ("first", "second", "third", "third")


def context(lines: list[str]) -> Context:
    """Names that bear no role are speakers where they are written as the first marker is: any two, and more that
    come again. Beside markers with roles there is one at most: where the user or the assistant has no marker, a name that
    the transcript begins with or that comes again."""
    found = [m for m in map(marker, lines) if m]
    first = marker(next((x for x in lines if x.strip()), ""))
    if not first:
        return Context(next((m.style for m in found if m.name in _ROLE_OF), ""))
    alike = Counter(m.name for m in found if m.style == first.style)
    roles = {_ROLE_OF[n] for n in alike if n in _ROLE_OF}
    others = [n for n in alike if n not in _ROLE_OF]
    if not roles:
        return Context(first.style, tuple(n for k, n in enumerate(others) if k < 2 or alike[n] > 1)[: len(SPEAKERS)])
    missing = [r for r in ("user", "assistant") if r not in roles]
    other = next((n for n in others if n == first.name or alike[n] > 1), None)
    if len(missing) == 1 and other:
        return Context(first.style, (other,), missing[0])
    return Context(first.style)


def speaker(name: str, own: Context) -> str:
    """What a marker's name stands for: a role, a speaker by number, or ``other``."""
    if name in own.names:
        return own.missing or SPEAKERS[own.names.index(name)]
    return _ROLE_OF.get(name, "other")


def observe(line: str, own: Context) -> tuple[tuple[str, str], ...]:
    text, m = line.strip(), marker(line)
    alike = m is not None and m.style == own.style
    return (
        ("marker", f"{speaker(m.name, own)} {'same' if alike else 'differs'}" if m else "none"),
        ("shape", m.shape if m and not alike else "none"),  # the own style's is told by the marker
        ("blank", str(not text)),
        ("words", str(min(6, len(text.split()).bit_length()))),
        ("asks", str(text.endswith("?"))),
        ("tells", str(text.lower().startswith(("you are", "act as", "respond", "always", "never")))),
    )


VALUES = {
    "marker": (*(f"{who} {how}" for who in (*ROLES, "first", "second", "third", "other") for how in ("same", "differs")), "none"),
    "shape": ("sign", "bracket", "heading", "tag", "time", "none"),
    "blank": ("True", "False"),
    "words": tuple(str(k) for k in range(7)),
    "asks": ("True", "False"),
    "tells": ("True", "False"),
}


@dataclass
class Hmm:
    """Log-chances by numbers of ``STATES``."""

    start: list[float]
    steps: list[list[float]]
    emit: list[dict]
    met: dict = field(default_factory=dict)

    def emissions(self, lines: list[str], own: Context) -> list[list[float]]:
        out = []
        for line in lines:
            seen = observe(line, own)
            scores = self.met.get(seen)
            if scores is None:
                scores = self.met[seen] = [sum(e[o] for o in seen) for e in self.emit]
            out.append(scores)
        return out

    def decode(self, lines: list[str], own: Context, entry: int | None = None, leave: int | None = None) -> list[int]:
        """The most likely state of each line; ties go to the state named first. ``entry`` is the state of
        the line before, if there is one, and ``leave`` the last line's, if it is known."""
        score, back = (self.start if entry is None else self.steps[entry]), []
        every = range(len(STATES))
        for i, e in enumerate(self.emissions(lines, own)):
            if i == 0:
                score = [score[s] + e[s] for s in every]
                continue
            came = [max(every, key=lambda r, s=s: score[r] + self.steps[r][s]) for s in every]
            score = [score[r] + self.steps[r][s] + e[s] for s, r in enumerate(came)]
            back.append(came)
        if not lines:
            return []
        out = [max(every, key=score.__getitem__) if leave is None else leave]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]

    def passage(self, lines: list[str], own: Context) -> tuple[list[list[float]], list[list[int]]]:
        """Of the best path through the lines for each state of the line before and of the last line: its
        score, and its first state."""
        every = range(len(STATES))
        scores, firsts = [], []
        for entry in every:
            score, first = list(self.steps[entry]), list(every)
            for i, e in enumerate(self.emissions(lines, own)):
                if i:
                    came = [max(every, key=lambda r, s=s: score[r] + self.steps[r][s]) for s in every]
                    score, first = [score[r] + self.steps[r][s] for s, r in enumerate(came)], [first[r] for r in came]
                score = [x + y for x, y in zip(score, e, strict=True)]
            scores.append(score)
            firsts.append(first)
        return scores, firsts


def fit(transcripts: list[tuple[list[str], list[tuple[str, bool]]]], smoothing: float = 0.5) -> Hmm:
    """Smoothed log-chances counted over lines with known states. A turn's role never changes inside it:
    a line that begins no turn keeps the role before it."""
    start: Counter = Counter()
    steps: dict = defaultdict(Counter)
    emit: dict = defaultdict(Counter)
    for lines, states in transcripts:
        own = context(lines)
        for i, (line, state) in enumerate(zip(lines, states, strict=True)):
            if i == 0:
                start[state] += 1
            else:
                steps[states[i - 1]][state] += 1
            emit[state].update(observe(line, own))
    possible = {r: [s for s in STATES if s[1] or s[0] == r[0]] for r in STATES}
    n_start = sum(start.values()) + smoothing * len(ROLES)
    log_start = [math.log((start[s] + smoothing) / n_start) if s[1] else IMPOSSIBLE for s in STATES]
    log_steps = []
    for r in STATES:
        total = sum(steps[r].values()) + smoothing * len(possible[r])
        log_steps.append([math.log((steps[r][s] + smoothing) / total) if s in possible[r] else IMPOSSIBLE for s in STATES])
    log_emit = []
    for s in STATES:
        totals = {k: sum(emit[s][(k, x)] for x in vs) + smoothing * len(vs) for k, vs in VALUES.items()}
        log_emit.append({(k, v): math.log((emit[s][(k, v)] + smoothing) / totals[k]) for k, vs in VALUES.items() for v in vs})
    return Hmm(log_start, log_steps, log_emit)


STYLES = ("User: ", "**User:** ", "[user] ", "<|user|> ", "### User: ", "U", "> User: ", "### User\n", "<user>", "User said: ", "10:01 user> ")


def mark(role: str, style: int, alias: int) -> str:
    """A speaker marker in one of ``STYLES``."""
    names = ALIASES[role]
    name = names[alias % min(3, len(names))]
    title = name.upper() if len(name) < 3 else name.capitalize()
    made = (
        f"{title}: ", f"**{title}:** ", f"[{name}] ", f"<|{name}|> ", f"### {title}: ", f"{names[0].upper()}: ", f"> {title}: ", f"### {title}\n", f"<{name}>", f"{title} said: ", f"10:01 {name}> ",
    )
    return made[style % len(STYLES)]


def transcript(turns: list[tuple[str, str]], seed: int, names: dict[str, str] | None = None) -> tuple[list[str], list[tuple[str, bool]]]:
    """The lines of a conversation in a style that ``seed`` decides, and their states. ``names`` stand
    for the roles' own where they are given."""
    rng = random.Random(seed)
    style, alias, gap = rng.randrange(len(STYLES)), rng.randrange(3), rng.random() < 0.3
    lines, states = [], []
    for role, text in turns:
        head = mark(role, style, alias)
        if names:
            head = f"{names[role]}: " if style % 3 == 0 else f"**{names[role]}:** " if style % 3 == 1 else f"[10:01] {names[role]}: "
        tail = f"</{head[1:-1]}>" if head.startswith("<") and head.endswith(">") and "|" not in head else ""
        for i, line in enumerate((head + text + tail).split("\n")):
            lines.append(line)
            states.append((role, i == 0))
        if gap:
            lines.append("")
            states.append((role, False))
    return lines, states


def _with_third(made: tuple[list[str], list[tuple[str, bool]]], names: dict[str, str], third: str, at: tuple[int, ...]) -> tuple[list[str], list[tuple[str, bool]]]:
    """A made transcript in which the turns ``at`` are a third speaker's."""
    lines, states = made
    begins = [i for i, (_, first) in enumerate(states) if first]
    for k in at:
        lines[begins[k]] = lines[begins[k]].replace(names["user"], third, 1)
    return lines, states


def default_model(seed: int = 11, n: int = 400) -> Hmm:
    """The model of ``n`` made conversations."""
    rng = random.Random(seed)
    syllables = ("an", "de", "er", "ou", "sta", "que", "ung")

    def phrase(least: int, most: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(least, most)))

    def aside() -> str:
        """A line inside a turn that looks like a marker or other markup."""
        kinds = ("A: {}", "Q: {}", "Note: {}", "model: {}", "agent: {}", "* {}", "- {}", "1. {}", "**{}** x", "key: {}", "    x = {}", "> {}", "# {}", "Step one: {}", "Warning - {}", "user: {}", "http://{}", "Warning: {}", "Result: {}", "Note: {}")
        return rng.choice(kinds).format(phrase(1, 5))

    def text(least: int, most: int) -> str:
        out = []
        if rng.random() < 0.15:
            return phrase(1, 2) + rng.choice(("", "?"))
        for _ in range(rng.randint(least, most)):
            out.append(phrase(2, 14).capitalize() + rng.choice((".", ".", "?", "")) + rng.choice((" ", " ", "\n", "\n\n")))
            if rng.random() < 0.12:
                out.append("\n" + aside() + "\n")
        return "".join(out).strip()

    made = []
    for k in range(n):
        names = {"user": phrase(1, 1).capitalize(), "assistant": phrase(1, 1).capitalize() + "o"} if rng.random() < 0.25 else None
        turns = [("system", rng.choice(("You are a helper. ", "Respond briefly. ", "")) + text(1, 2))] if not names and rng.random() < 0.3 else []
        for _ in range(rng.randint(1, 5)):
            turns += [("user", text(1, 4)), ("assistant", text(1, 8))]
            if rng.random() < 0.15:  # a speaker may go on in a turn of their own
                turns.append(rng.choice(turns[-2:]))
        if names and len(turns) > 4 and rng.random() < 0.3:  # a third speaker, who counts as a user
            third = "guest" + phrase(1, 1)
            for at in (4, 2):  # after the first two have spoken
                turns.insert(at, ("user", text(1, 3)))
            made.append(_with_third(transcript(turns, seed * 1000 + k, names), names, third.capitalize(), (2, 5)))
            continue
        if not names and rng.random() < 0.08:  # an excerpt may begin with an answer
            turns = [t for t in turns if t[0] != "system"][1:]
        made.append(transcript(turns, seed * 1000 + k, names))
    for _ in range(n // 40):  # text without any marker is the user's
        lines = text(1, 6).split("\n")
        made.append((lines, [("user", i == 0) for i in range(len(lines))]))
    return fit(made)


@dataclass
class Turn:
    role: str
    text: str
    begins: bool = True  # false for the first of a piece that goes on with the turn before


def turns_of(lines: list[str], states: list[int], own: Context) -> list[Turn]:
    """Turns of decoded lines: the markers of lines that begin turns are taken off where they name a
    speaker, and closing tags of that role or of any with a turn's last line; white space around a turn
    goes, and empty turns too."""
    turns: list[tuple[str, list[str], bool, Marker | None]] = []
    for line, state in zip(lines, states, strict=True):
        role, begins = STATES[state]
        if begins or not turns:
            m = marker(line) if begins else None
            named = m and (_ROLE_OF.get(m.name) == role or m.name in own.names)
            turns.append((role, [line[m.end :] if named else line], begins, m if named else None))
        else:
            turns[-1][1].append(line)
    stripped = [Turn(role, _closed("\n".join(x).strip(), m), begins) for role, x, begins, m in turns]
    return [t for t in stripped if t.text]


def _closed(text: str, m: Marker | None) -> str:
    """Without the tag that closes the turn, where the turn began with one of its kind: elsewhere it is text."""
    end = _CLOSING.search(text) if m and m.shape == "tag" else None
    if not end or bool(end["xml"]) != m.style.startswith("<>") or end["xml"] and end["xml"].lower() != m.name:
        return text
    return text[: end.start()].strip()


def parse(text: str, model: Hmm) -> list[tuple[str, str]]:
    """(role, text) of each turn of a transcript. A text of no words has no turns. Of speakers that bear
    names instead of roles the first to speak is the user, the second the assistant, and further ones who
    come again are users too."""
    lines = text.split("\n") if text.strip() else []
    own = context(lines)
    return [(t.role, t.text) for t in turns_of(lines, model.decode(lines, own), own)]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: ``<|role|>``, a line feed, the text and ``<|end|>`` for each turn. In a text
    each ``<|`` gets a backslash between, so that no text can end a turn or begin one."""
    return "".join(f"<|{role}|>\n{_escape(text)}<|end|>\n" for role, text in turns)


def _escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unrender(chat: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    return [(role, re.sub(r"<\\(\\*)\|", r"<\1|", text)) for role, text in re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", chat, re.S)]


FORMATTED = T.StructType(
    [
        T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("chat", T.StringType()),
    ]
)


def format_transcripts(df: DataFrame, model: Hmm | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``turns`` (array of role and text) and ``chat``, the canonical rendering, of each transcript.

    Null and empty texts have no turns and an empty rendering. One row for each row, repeated or not;
    columns named like an output are replaced. A text of any length is decoded whole, by one task.
    """
    from framewright.llm.arrow import append_columns

    held = df.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred numbers

    def make():
        m = held.value

        def run(col: pa.Array) -> list:
            turns = [parse(x or "", m) for x in col.to_pylist()]
            return [[[{"role": r, "text": x} for r, x in t] for t in turns], [render(t) for t in turns]]

        return run

    return append_columns(df, text_col, FORMATTED, make, keep)


#: A conversation of up to so many turns and bytes is one row, made by one task.
WHOLE_TURNS, WHOLE_BYTES = 50_000, 16 << 20
#: Bytes of turns in a piece of a longer one.
PIECE_BYTES = 8 << 20

RECOVERED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("piece", T.LongType()),
        T.StructField("n_given", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("n_right", T.LongType()),
        T.StructField("chat", T.StringType()),
    ]
)


def format_conversations(turns: DataFrame, model: Hmm | None = None) -> DataFrame:
    """Writes each conversation of (conv_id, turn, role, text) rows as a transcript in a style drawn from
    its id, hides the roles, recovers them and renders the result.

    One row for each conversation: ``conv_id``, ``piece`` (0), ``n_given`` (turns with words), ``n_turns``
    (turns found), ``n_right`` (those whose role and text came back as they were) and ``chat``. One of over
    ``WHOLE_TURNS`` turns or ``WHOLE_BYTES`` would be one task's work, so it comes out as consecutive
    pieces, in order of ``piece``; they are decoded as one chain all the same, so that their chats joined
    are the chat of the whole.

    Null and empty texts are turns that a transcript doesn't show; null and unknown roles count as the
    user's; null turn numbers come first; of repeated turn numbers the order is by role and text, and
    repeated rows are repeated turns. Rows with a null conv_id are one conversation. Other columns are left
    out, whatever their names. An empty table gives an empty result.
    """
    held = turns.sparkSession.sparkContext.broadcast(model or default_model())
    role = F.lower(F.coalesce("role", F.lit("user")))
    role = F.when(role.isin(*ROLES), role).otherwise("user")
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = cut(sizes.filter((F.col("n") > WHOLE_TURNS) | (F.col("bytes") > WHOLE_BYTES)).select(F.col("conv_id").alias("_conv"), "bytes"))
    size = long.agg(F.sum("bytes")).first()[0]
    if size is None:
        return rows.groupBy("conv_id").applyInArrow(_recover(held), RECOVERED)
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    whole = rows.join(long, same, "left_anti").groupBy("conv_id").applyInArrow(_recover(held), RECOVERED)
    return whole.unionByName(_in_pieces(rows.join(long, same, "left_semi"), held, max(2, -(-size // PIECE_BYTES))))


def _known(table: pa.Table) -> list[tuple[str, str]]:
    rows = sorted(zip(table.column("turn").to_pylist(), table.column("role").to_pylist(), table.column("text").to_pylist(), strict=True))
    return [(role, text.strip()) for _, role, text in rows if text.strip()]


def _seed(table: pa.Table) -> int:
    return zlib.crc32(str(table.column("conv_id")[0].as_py()).encode())


def _result(table: pa.Table, piece: int, known: list, found: list[Turn], chat: str) -> pa.Table:
    right = sum((Counter(known) & Counter((t.role, t.text) for t in found)).values())
    row = {"conv_id": table.column("conv_id")[0].as_py(), "piece": piece, "n_given": len(known), "n_turns": sum(t.begins for t in found), "n_right": right, "chat": chat}
    return pa.Table.from_pylist([row], schema=to_arrow_schema(RECOVERED))


def _recover(held):
    def run(table: pa.Table) -> pa.Table:
        model, known = held.value, _known(table)
        lines, _ = transcript(known, _seed(table))
        own = context(lines)
        found = turns_of(lines, model.decode(lines, own), own)
        return _result(table, 0, known, found, render([(t.role, t.text) for t in found]))

    return run


_STYLE = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("style", T.StringType())])
_PASSAGE = T.StructType([*_STYLE.fields[:2], T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("firsts", T.ArrayType(T.LongType()))])
_ENDS = T.StructType([*_STYLE.fields[:2], *[T.StructField(c, T.LongType()) for c in ("number", "entry", "leave", "after")]])


def _in_pieces(rows: DataFrame, held, n: int) -> DataFrame:
    """Long conversations: dealt into pieces by ranges of their order (repeated rows too, by a salt); each
    piece gives the best paths through it for all states at its ends, a chain of these small tables gives
    the states at all ends, and with them each piece is decoded by itself."""
    order = ["conv_id", "turn", "role", "text", "salt"]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *order)
    dealt = cut(dealt.withColumn("piece", F.spark_partition_id().cast("long")).drop("salt"))

    def lines_of(table: pa.Table) -> tuple[list, list[str]]:
        known = _known(table)
        return known, transcript(known, _seed(table))[0]

    def key(table: pa.Table) -> dict:
        return {c: table.column(c)[0].as_py() for c in ("conv_id", "piece")}

    def styles(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([key(table) | {"style": context(lines_of(table)[1]).style or None}], schema=to_arrow_schema(_STYLE))

    found = dealt.groupBy("conv_id", "piece").applyInArrow(styles, _STYLE).filter("style IS NOT NULL")
    first = cut(found.groupBy("conv_id").agg(F.min_by("style", "piece").alias("style")).withColumnRenamed("conv_id", "_conv"))
    named = dealt.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")

    def passages(table: pa.Table) -> pa.Table:
        lines, own = lines_of(table)[1], Context(table.column("style")[0].as_py() or "")
        made = []
        if lines:
            scores, firsts = held.value.passage(lines, own)
            made = [key(table) | {"scores": sum(scores, []), "firsts": sum(firsts, [])}]
        return pa.Table.from_pylist(made, schema=to_arrow_schema(_PASSAGE))

    def chain(table: pa.Table) -> pa.Table:
        """States at the ends of one conversation's pieces, some 600 bytes each."""
        model, k = held.value, len(STATES)
        pieces = sorted(table.to_pylist(), key=lambda r: r["piece"])
        scores = [[r["scores"][i * k : i * k + k] for i in range(k)] for r in pieces]
        # The first piece begins from the start: its best entry is no state at all.
        at, came = [], []
        for i, s in enumerate(scores):
            if i == 0:
                fresh = [[s[e][x] - model.steps[e][f] + model.start[f] for x, f in enumerate(pieces[0]["firsts"][e * k : e * k + k])] for e in range(k)]
                best = [max(range(k), key=lambda e, x=x: fresh[e][x]) for x in range(k)]
                at, came = [[fresh[e][x] for x, e in enumerate(best)]], [best]
            else:
                best = [max(range(k), key=lambda e, x=x: at[-1][e] + s[e][x]) for x in range(k)]
                at.append([at[-1][e] + s[e][x] for x, e in enumerate(best)])
                came.append(best)
        leave, out, after = max(range(k), key=at[-1].__getitem__), [], -1
        for i in reversed(range(len(pieces))):
            entry = came[i][leave]
            out.append({"conv_id": pieces[i]["conv_id"], "piece": pieces[i]["piece"], "number": i, "entry": entry if i else -1, "leave": leave, "after": after})
            after, leave = pieces[i]["firsts"][entry * k + leave], entry
        return pa.Table.from_pylist(out, schema=to_arrow_schema(_ENDS))

    ends = cut(named.groupBy("conv_id", "piece").applyInArrow(passages, _PASSAGE).groupBy("conv_id").applyInArrow(chain, _ENDS))

    def decode(table: pa.Table, end: pa.Table) -> pa.Table:
        if not table.num_rows or not end.num_rows:
            return to_arrow_schema(RECOVERED).empty_table()
        model, (known, lines), own = held.value, lines_of(table), Context(table.column("style")[0].as_py() or "")
        e = end.to_pylist()[0]
        states = model.decode(lines, own, None if e["entry"] < 0 else e["entry"], e["leave"])
        found = turns_of(lines, states, own)
        chat = render([(t.role, t.text) for t in found])
        if found and not found[0].begins:  # goes on with the turn of the piece before
            chat = "\n" + chat.split("\n", 1)[1]
        if e["after"] >= 0 and not STATES[e["after"]][1]:
            chat = chat.removesuffix("<|end|>\n")
        return _result(table, e["number"], known, found, chat)

    return named.groupBy("conv_id", "piece").cogroup(ends.groupBy("conv_id", "piece")).applyInArrow(decode, RECOVERED)

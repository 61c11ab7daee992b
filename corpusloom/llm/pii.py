"""Personal data, with disguises undone by transducers that keep offsets.

The base patterns run over the text as it is. A second pass undoes disguises: transducers (tries of rewriting rules,
longest match first) replace look-alike letters and digits, drop invisible characters, spell number words as digits and
turn "(at)", "[dot]", "at ... dot ...", "_at_ ... _dot_ ..." into the characters they stand for. Every output character carries the source
span it came from, so that a match in the normalised text maps back to exact code points. Matches of the second pass
that touch no base span of their kind are added; base spans always stay.

Both passes read whole texts in time linear in their length. The second runs only over texts in which a disguise can
begin; that test looks at the text, not at its length or its place.

Defined edge cases: a null or empty text has no spans. Repeated rows are scanned row by row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cover, map_rows, table

#: Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_AT = re.compile(f"@({DOMAIN})")
LOCAL_END = re.compile(f"{LOCAL}+$")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches. A match starts where the run of local characters before an @ starts, or where
    the match before it ended; looking back from each @ keeps long runs without one linear."""
    out, free = [], 0
    for m in EMAIL_AT.finditer(text) if "@" in text else ():
        at = m.start()
        start = at
        while start > free and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at:
            out.append(("email", start, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    """All base matches, by kind as listed, then start."""
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


class Tape:
    """Characters, and for each the span of source characters that it came from."""

    def __init__(self, chars: list[str], starts: list[int], ends: list[int]):
        self.chars, self.starts, self.ends = chars, starts, ends

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(list(text), list(range(len(text))), list(range(1, len(text) + 1)))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


class Transducer:
    """Rewrites by a trie of rules, longest match first, left to right. Rules match in either case. whole: a match must
    not touch a letter or digit on either side."""

    def __init__(self, rules: dict[str, str], whole: bool = False):
        self.whole, self.root = whole, {}
        for source, target in rules.items():
            node = self.root
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target

    def run(self, tape: Tape) -> Tape:
        chars, n, at = tape.chars, len(tape.chars), 0
        out, starts, ends = [], [], []
        while at < n:
            node, to, end, target = self.root, at, -1, ""
            if not self.whole or at == 0 or not chars[at - 1].isalnum():
                while to < n and (node := node.get(chars[to].lower() if chars[to] not in node else chars[to])) is not None:
                    to += 1
                    if "" in node and (not self.whole or to == n or not chars[to].isalnum()):
                        end, target = to, node[""]
            if end < 0:
                end, target = at + 1, chars[at]
            out += target
            starts += [tape.starts[at]] * len(target)
            ends += [tape.ends[end - 1]] * len(target)
            at = end
        return Tape(out, starts, ends)


def _runs(first: int, targets: str) -> dict[str, str]:
    return {chr(first + i): c for i, c in enumerate(targets)}


#: Characters that look like ASCII ones; full-width forms follow from their code points.
LOOKALIKES = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "м": "m", "т": "t", "н": "h", "к": "k", "в": "b",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "。": ".", "․": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-",
}
LOOKALIKES |= {d: c for first in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d, c in _runs(first, "0123456789").items()}
INVISIBLE = dict.fromkeys("\u00ad\u200b\u200c\u200d\u2060\ufeff", "")
NUMBER_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

SIGNS = {f"{a}{s}{word}{s}{b}": sign for word, sign in (("at", "@"), ("dot", "."), ("@", "@"), (".", ".")) for a, b in ("()", "[]", "{}", "<>") for s in ("", " ")}

FOLD = Transducer(LOOKALIKES | INVISIBLE)
BRACKETED = Transducer(SIGNS | {f" {k} ": v for k, v in SIGNS.items()} | {f" {k}": v for k, v in SIGNS.items()} | {f"{k} ": v for k, v in SIGNS.items()})

_NUMBER = "(?:" + "|".join(NUMBER_WORDS) + ")"
ODD = re.compile("[" + "".join(re.escape(c) for c in sorted({*LOOKALIKES, *INVISIBLE})) + "]")
#: Words that repeat the digit after them.
TIMES = {"double": 2, "triple": 3}
_TIMES = r"(?:(?:" + "|".join(TIMES) + r")[\s-]+)?"
_UNIT = rf"{_TIMES}(?:{_NUMBER}|[0-9]++)\b"
_GAP = r"[\s,.()-]++(?:(?:dot|point)\b[\s,.()-]++)?"
#: Number words and digits side by side, or with "dot" or "point" between them.
RUN = re.compile(rf"(?ai)(?<![a-z0-9_])(?:plus\W+)?{_UNIT}(?:{_GAP}{_UNIT})+")
PART = re.compile(rf"(?ai)plus\b|{_TIMES}{_NUMBER}\b|[0-9]+")
#: Digits among which capital or small letters stand for others.
MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ .()-]{0,2}[0-9OoIl])+(?![A-Za-z0-9])")
MIXED_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1"}
POINT = re.compile(r"(?ai)\b(?:dot|point)\b")
SIGNED = re.compile(r"(?ai)[(\[{<]\s?(?:at|dot|[@.])\s?[)\]}>]")
#: A domain behind a sign, its stops between blanks.
SPACED = re.compile(r"(?ai)@\s?([a-z0-9-]++(?:\s\.\s[a-z0-9-]++)++)")
SPACED_DOT = re.compile(r"\s\.\s")
#: A local part however long, and what makes an address of it where that follows; a local part is read once either way.
SPOKEN = re.compile(r"(?ai)(?<![a-z0-9._%+-])([a-z0-9._%+-]++(?:\s+dot\s+(?!at\s)[a-z0-9._%+-]++)*)(?:(\s+at\s+|\s?@\s?)([a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)+)\b)?")
DOT = re.compile(r"(?ai)\sdot\s")
AT = re.compile(r"(?ai)\sat\s")
PLAIN_AT = re.compile(r"(?ai)(?<![a-z0-9._%+-])([a-z0-9._%+-]++)(\s+at\s+)([a-z0-9-]++(?:\.[a-z0-9-]++)++)")
GLUED_AT, GLUED_DOT = re.compile(r"(?ai)[_-]at[_-]"), re.compile(r"(?ai)[_-]dot[_-]")
GLUED = re.compile(r"(?ai)(?<![a-z0-9._%+-])[a-z0-9._%+-]++")
#: Generic top-level domains, and words of two letters that are no country's in a spoken address.
GENERIC_DOMAINS = frozenset("com org net edu gov mil int info biz name pro museum aero coop jobs mobi tel travel cat asia post xxx app dev blog shop site online tech store cloud live".split())
SHORT_WORDS = frozenset("ab ad ah al am an as at au by da do du ei el em en er es et go he hi id if il in is it je la le lo ma me mi mu my na ne no nu of oh ok on or os ou ox pa pi re sa se si so su te ti to tu un up us va wa we wo ya ye zu".split())
SPOKEN_DOT = re.compile(r"(?ai)\s+dot\s+")


#: What ends a clause; a country's code that is a common word too counts only before it.
CLAUSE_END = re.compile(r"[ \t]*(?:[.,;:!?)\]}>\"'|]|[\r\n]|$)")


def _ends_well(domain: str, text: str, end: int) -> bool:
    """Whether a domain in bare words, before end in text, ends like one, and not like a sentence."""
    last = re.split(r"[\s._-]", domain.lower())[-1]
    return last in GENERIC_DOMAINS or (len(last) == 2 and last.isalpha() and (last not in SHORT_WORDS or CLAUSE_END.match(text, end) is not None))


def _spoken(tape: Tape) -> Tape:
    """Bare "x at y dot z" and x_at_y_dot_z: at and dot become signs only where they stand together in such a form and the
    domain ends in a known way. "x at y.z" counts where x has a sign or digit, since words stand before web sites too."""
    text, cut = "".join(tape.chars), []
    for m in SPOKEN.finditer(text) if DOT.search(text) else ():
        for k in (1, 3) if m[2] and (m[2].strip() == "@" or _ends_well(m[3], text, m.end(3))) else ():
            cut += [(m.start(k) + d.start(), m.start(k) + d.end(), ".") for d in SPOKEN_DOT.finditer(m[k])]
            if k == 1:
                cut.append((m.start(2), m.end(2), "@"))
    for m in PLAIN_AT.finditer(text) if AT.search(text) else ():
        if not m[1].isalpha() and _ends_well(m[3], text, m.end(3)):
            cut.append((m.start(2), m.end(2), "@"))
    for m in GLUED.finditer(text) if GLUED_AT.search(text) else ():
        at = GLUED_AT.search(m[0])
        if at and at.start() and GLUED_DOT.search(m[0], at.end()) and _ends_well(m[0], text, m.end()):
            cut.append((m.start() + at.start(), m.start() + at.end(), "@"))
            cut += [(m.start() + d.start(), m.start() + d.end(), ".") for d in GLUED_DOT.finditer(m[0], at.end())]
    for m in SPACED.finditer(text) if "@" in text else ():
        if _ends_well(m[1], text, m.end()):
            if m.start(1) > m.start() + 1:
                cut.append((m.start() + 1, m.start(1), ""))
            cut += [(m.start(1) + d.start(), m.start(1) + d.end(), ".") for d in SPACED_DOT.finditer(m[1])]
            if m.start() and text[m.start() - 1] in " \t":
                cut.append((m.start() - 1, m.start(), ""))
    out, free = [], 0
    for c in sorted(cut):
        if c[0] >= free:
            out.append(c)
            free = c[1]
    return _spliced(tape, out)


def _worded(run: str) -> bool:
    """Whether a run is more than digits."""
    return any(c.isalpha() for c in run)


def _spelled(tape: Tape, dots: bool = False, glued: bool = False) -> Tape:
    """Number words beside digits or other number words become digits, without what stands between words; what stands
    beside digits stays, unless glued and a word is on its other side. "dot" and "point" become a dot; with dots, a lone
    dot between words stays."""
    text, cut = "".join(tape.chars), []
    for m in RUN.finditer(text):
        if not _worded(m[0]):
            continue
        before = None
        for p in PART.finditer(text, m.start(), m.end()):
            word = not p[0].isdigit()
            if before is not None:
                gap = text[before.end() : p.start()]
                if POINT.search(gap) or (dots and gap == "."):
                    cut.append((before.end(), p.start(), "."))
                elif word + (not before[0].isdigit()) + glued > 1:
                    cut.append((before.end(), p.start(), ""))
            if word:
                said = re.split(r"[\s-]+", p[0].lower())
                cut.append((p.start(), p.end(), NUMBER_WORDS.get(said[-1], "+") * (TIMES[said[0]] if len(said) > 1 else 1)))
            before = p
    return _spliced(tape, cut)


def _mixed(tape: Tape) -> Tape:
    """Letters that look like digits become these in runs of at least as many digits."""
    text, cut = "".join(tape.chars), []
    for m in MIXED.finditer(text):
        letters = [i for i in range(m.start(), m.end()) if text[i] in MIXED_DIGITS]
        if letters and len(letters) <= sum(c.isdigit() for c in m[0]):
            cut += [(i, i + 1, MIXED_DIGITS[text[i]]) for i in letters]
    return _spliced(tape, cut)


def _has_mixed(text: str) -> bool:
    """Whether a run could be an identifier with letters among its digits; the shortest one has four characters."""
    for m in MIXED.finditer(text):
        letters, digits = sum(c in MIXED_DIGITS for c in m[0]), sum(c.isdigit() for c in m[0])
        if 0 < letters <= digits and letters + digits >= 4:
            return True
    return False


def _spliced(tape: Tape, cut: list[tuple[int, int, str]]) -> Tape:
    if not cut:
        return tape
    chars, starts, ends, at = [], [], [], 0
    for a, b, target in cut:
        chars += tape.chars[at:a] + list(target)
        starts += tape.starts[at:a] + [tape.starts[a]] * len(target)
        ends += tape.ends[at:a] + [tape.ends[b - 1]] * len(target)
        at = b
    return Tape(chars + tape.chars[at:], starts + tape.starts[at:], ends + tape.ends[at:])


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of the normalised text, in source code points, that touch no base span of their kind."""
    odd = not text.isascii() and ODD.search(text)
    if not (odd or SIGNED.search(text) or DOT.search(text) or (AT.search(text) and PLAIN_AT.search(text)) or (GLUED_AT.search(text) and GLUED_DOT.search(text)) or SPACED.search(text) or _has_mixed(text) or any(_worded(m[0]) for m in RUN.finditer(text))):
        return []
    tape = Tape.of(text)
    for stage in (FOLD.run, BRACKETED.run, _spoken, _mixed):
        tape = stage(tape)
    out: list[Span] = []
    done = {text}
    for how in ({}, {"dots": True}, {"glued": True}):  # a dot or comma may set off parts of one number, or two of them
        read = _spelled(tape, **how)
        flat = "".join(read.chars)
        if flat in done:
            continue
        done.add(flat)
        new, known = [], {kind: Cover((a, b) for k, a, b in base + out if k == kind) for kind in KINDS}
        for kind, a, b in base_spans(flat):
            start, end = read.source(a, b)
            while end > start and text[end - 1].isspace():
                end -= 1
            if text[start:end] != flat[a:b] and not known[kind].touches(start, end):
                new.append((kind, start, end))
        out += new
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def scan_rows(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": batch["doc_id"]} | {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised")}
    for text in batch["text"]:
        text = text or ""
        base = base_spans(text)
        more = disguised_spans(text, base)
        for kind in KINDS:
            out[f"n_{kind}"].append(sum(x[0] == kind for x in base))
        out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
        out["spans"].append(listed(base + more))
        out["n_disguised"].append(len(more))
    return out


def scan_pii(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text)."""
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), scan_rows, SCHEMA)


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))

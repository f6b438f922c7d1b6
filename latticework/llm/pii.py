"""Personal data: patterns with checks, and a character BiLSTM-CRF for forms that the patterns don't cover.

The base spans are what the four patterns find. The tagger is trained on labelled spans: base spans of at most
about ``sample`` documents (drawn by a hash among those that have a digit or an at sign), in their contexts, as written
and rewritten to other surface forms (a phone without its plus, an address with "at" spelt out, a grouped card number),
and on generated ones after cue words, with everything else around them labelled as text: the contexts' own numbers,
and generated dates, versions, ISBNs, order and serial numbers, hashes and the like. It reads texts in overlapping windows of ``WINDOW`` characters, and every
character belongs to the window in whose middle half it lies: a window's span counts if its own centre does. Spans of
all windows are then put in order, and those that overlap a base span or an earlier one, or fail the check of their
kind, are dropped.

A span must hold a digit or an at sign outside base spans, by those checks; so windows without any have nothing to add
and are not decoded. No text is cut.

Defined cases: null or empty text has no spans; offsets are code points; rows that repeat an id are read each; a
null id is returned; extra columns are ignored; an empty table gives an empty result; without any labelled span the
tagger learns from generated ones alone.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.bilstm_crf import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: The base patterns, each in a form that reads a text once: what may come before is settled at the first character.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELT = re.compile(r"\s*[(\[]\s*at\s*[)\]]\s*", re.I)
#: What may be personal data: addresses, and runs of eight digits or more. Other numbers stay in the contexts, as they are no spans.
LONG = re.compile(r"\S*@\S*|\S*\s?[(\[]\s?at\s?[)\]]\s?\S*|[+(]?(?:[0-9][ ().\[\]/-]{0,3}){7,}[0-9]", re.I)
TRIGGER = re.compile(r"[0-9@]|[(\[]\s?at\s?[)\]]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def small_parts(s: str) -> bool:
    return all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = AT.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        else:
            end = at + 1
        at = text.find("@", end)
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if small_parts(m[0])]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """The check of a span that the tagger proposes."""
    s = text[start:end]
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) or "\n" in s:
        return False
    digits = digits_of(s)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|[(\[]\s?at\s?[)\]])\s?[\w-]+(?:\s?(?:\.|[(\[]\s?dot\s?[)\]]|\bdot\b)\s?[\w-]+)+", s, re.I))
    if kind == 1:
        return bool(re.fullmatch(r"\d{1,3}(?:(?:\[\.\]|\s?\.\s?)\d{1,3}){3}", s, re.A)) and all(int(x) <= 255 for x in re.findall("[0-9]+", s))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./-]{0,3}[0-9])+", s)) and 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return bool(re.fullmatch(r"(?:\+|00)?[0-9(][0-9() ./-]*[0-9]", s)) and 9 <= len(digits) <= 15 and len(re.findall("[0-9]+", s)) >= 3 and s.count("(") == s.count(")")


def trimmed(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The longest plausible part of a proposed span, without up to three of its words at the end or start."""
    marks = [m.span() for m in re.finditer(r"[^ .,;:<>\"']+(?:[.,;:]+[^ .,;:<>\"']+)*", text[start:end])]
    for cut in range(min(4, len(marks))):
        for head in range(cut + 1):
            left, right = marks[head][0], marks[len(marks) - 1 - (cut - head)][1]
            for a in (start + left, start + left - 1):  # an opening bracket or plus may stand before the first word
                if start <= a and a < start + right and plausible(kind, text, a, start + right):
                    return a, start + right
    return None


#: Words that stand before personal data of each kind, and before other numbers, in generated contexts.
CUES = (
    ("write to", "mail:", "e-mail", "contact", "reach me under", "send it to", "address is", "from", "cc"),
    ("server", "host", "ping", "address", "ip", "from", "node", "connect to", "at", "router"),
    ("card", "credit card", "card number", "paid with", "visa", "charge", "card no.", "mastercard", "debit card"),
    ("call", "tel.", "phone", "phone:", "my number is", "ring", "mobile", "fax", "tel:", "dial", "reach me at"),
)
OTHER_CUES = ("ISBN", "order", "order no.", "invoice", "part number", "version", "serial", "id", "tracking code", "DOI", "section", "model", "ticket", "ref.", "on", "pages", "account", "No.", "code", "item")


class Labelled:
    """Windows with labelled spans, in more forms than the patterns know, and with numbers that are no personal data."""

    def __init__(self, seed: int = 7):
        self.rng = random.Random(seed)

    def digits(self, k: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(k))

    def word(self, least: int, most: int) -> str:
        return "".join(self.rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.rng.randint(least, most)))

    def value(self, kind: int) -> str:
        rng = self.rng
        if kind == 0:
            name = self.word(1, 8) + rng.choice(["", f".{self.word(2, 8)}", f"_{self.word(2, 8)}", f"-{self.word(2, 5)}", str(rng.randrange(999)), f".{self.word(3, 7)}{rng.randrange(99)}"])
            host = self.word(3, 9) + rng.choice(["", "", f"-{self.word(2, 7)}", f".{self.word(3, 7)}"])
            return f"{name}@{host}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'info', 'co.uk', 'edu', self.word(2, 3)])}"
        if kind == 1:
            return ".".join(str(rng.randrange(rng.choice([10, 100, 256, 256]))) for _ in range(4))
        if kind == 2:
            d = rng.choice("3456") + self.digits(rng.choice([12, 13, 14, 14, 14, 14]))
            return next(d + c for c in "0123456789" if luhn(d + c))
        return f"+{rng.randrange(1, 99)} ({self.digits(3)}) {self.digits(3)}-{self.digits(4)}"

    def rewrite(self, kind: int, s: str) -> str:
        """The value, mostly in another surface form."""
        rng = self.rng
        if rng.random() < 0.15:
            return s
        if kind == 0:
            name, _, host = s.partition("@")
            at = rng.choice([" (at) ", " [at] ", "(at)", "[at]", " @ ", " (AT) ", "@"])
            return name + at + host.replace(".", rng.choice([".", ".", " dot ", " (dot) ", "[dot]", " [dot] ", "(dot)", " . "]))
        if kind == 1:
            return s.replace(".", rng.choice([".", "[.]", " . "]))
        d = digits_of(s)
        if kind == 2:
            sep = rng.choice(["-", " ", ".", "", "/", " - ", "  "])
            cuts = [4, 10] if len(d) == 15 and rng.random() < 0.8 else range(4, len(d), 4)
            return sep.join(d[a:z] for a, z in zip([0, *cuts], [*cuts, len(d)]))
        area, mid, last = self.digits(3), self.digits(3), self.digits(4)
        sep = rng.choice("-. /")
        return rng.choice([
            f"({area}) {mid}-{last}", f"({area}){mid}-{last}", f"{area}{sep}{mid}{sep}{last}", f"{area}{sep}{mid}{sep}{last}", f"{area}/{mid}-{last}", f"001 {area} {mid} {last}", f"1-{area}-{mid}-{last}",
            f"0{area[:2]}{rng.choice(' /-')}{self.digits(rng.choice([3, 4]))} {self.digits(rng.choice([3, 4]))}", f"00{area[:2]} {mid} {self.digits(3)} {last}", f"0{area} {self.digits(2)} {self.digits(2)} {self.digits(2)}", f"00{area[:2]} {area} {mid} {last}",
            f"(0{area[:2]}) {self.digits(4)} {self.digits(4)}",
        ])

    def noise(self) -> str:
        """A number, code or date of no person."""
        rng, n = self.rng, self.digits
        year, month, day, small = str(rng.randrange(1900, 2040)), f"{rng.randrange(1, 13):02d}", f"{rng.randrange(1, 29):02d}", str(rng.randrange(30))
        isbn = rng.choice(["978", "979"]) + n(10)
        kinds = [
            lambda: f"{isbn[:3]}-{isbn[3]}-{isbn[4:6]}-{isbn[6:12]}-{isbn[12]}", lambda: f"{isbn[:3]}-{isbn[3]}-{isbn[4:8]}-{isbn[8:12]}-{isbn[12]}", lambda: isbn, lambda: f"{isbn[3]}-{isbn[4:7]}-{isbn[7:12]}-{rng.choice('0123456789X')}",
            lambda: f"{year}-{month}-{day}", lambda: f"{day}.{month}.{year}", lambda: f"{day}/{month}/{year}", lambda: f"{year}-{rng.randrange(1900, 2040)}, {year}-{rng.randrange(1900, 2040)}", lambda: f"{year}-{month}-{day} {n(2)}:{n(2)}",
            lambda: ".".join(str(rng.randrange(30)) for _ in range(rng.choice([2, 3, 3]))), lambda: f"v{small}.{n(1)}.{n(2)}", lambda: f"10.{n(4)}/{n(6)}.{year}", lambda: f"10.{n(4)}/{self.word(3, 6)}.{n(4)}",
            lambda: f"{n(4)}-{n(7)}", lambda: f"{n(5)}/{year}", lambda: f"{n(3)}-{n(3)}-{n(4)}-{rng.choice('ABCX')}", lambda: f"{n(5)}-{n(5)}-{n(5)}", lambda: f"{n(4)} {n(4)} {n(4)} {n(2)}", lambda: f"{n(4)}-{n(4)}-{n(4)}",
            lambda: f"{rng.choice('ABCX')}{n(2)}-{n(3)}-{n(4)}", lambda: n(rng.randint(1, 14)), lambda: f"{n(3)},{n(3)}", lambda: f"{n(1)},{n(3)},{n(3)}", lambda: f"${n(3)}.{n(2)}", lambda: f"#{n(5)}", lambda: f"{n(2)}:{n(2)}", lambda: f"{n(3)}-{n(3)}",
            lambda: f"AKIA{self.word(16, 16).upper()}", lambda: f"{rng.getrandbits(160):040x}", lambda: f"password={rng.getrandbits(60):x}", lambda: f"{small}.{n(5)}, {small}.{n(5)}", lambda: f"{n(1)}-{n(1)}, {n(2)}-{n(2)}", lambda: f"{n(6)}.{year}",
            lambda: "@" + self.word(4, 9), lambda: f"{n(8)}-{n(4)}", lambda: f"{n(2)} {n(3)} {n(3)}", lambda: f"{n(3)} {n(3)}",
        ]
        return rng.choice(kinds)()

    def prose(self) -> str:
        """Some made-up words, as context."""
        rng, out = self.rng, []
        for _ in range(rng.randint(0, 14)):
            word = self.word(1, 9)
            out.append((word.capitalize() if rng.random() < 0.15 else word) + rng.choice(["", "", "", "", "", ",", ".", ":", "\n"]))
        return " ".join(out)

    def windows(self, contexts: list[tuple[str, str, int, str]], count: int):
        """``count`` windows and their tags. contexts: text before and after a span, its kind (-1: none), its text."""
        rng = self.rng
        ids, tags = np.empty((count, WINDOW), np.int64), np.zeros((count, WINDOW), np.int64)
        for k in range(count):
            before, after, kind, value = rng.choice(contexts)
            before, after = LONG.sub("", before), LONG.sub("", after)  # other spans there have no labels
            if rng.random() < 0.5:
                before, after = self.prose(), self.prose()
            if kind < 0 or rng.random() < 0.5:
                kind = rng.choice([0, 1, 2, 3, 0, 3])
                value = self.value(kind)
            if rng.random() < 0.4:
                kind, value = -1, self.noise()
            else:
                value = self.rewrite(kind, value)
            left, right = before.rstrip("(\"'") + (" " if before and before[-1].isalnum() else ""), (" " if after and after[0].isalnum() else "") + after
            if rng.random() < 0.5:
                cue = rng.choice(OTHER_CUES if kind < 0 else CUES[kind])
                left += (cue.capitalize() if rng.random() < 0.3 else cue) + rng.choice([" ", " ", " ", "\n", ": ", " is "])
                right = rng.choice([".", ",", "", " and", " or", "\n", ";"]) + right
            if rng.random() < 0.2:
                pair = rng.choice(["()", "<>", '""', "[]", "''"])
                left, right = left + pair[0], pair[1] + right
            room = rng.randint(0, max(0, WINDOW - len(value)))
            left = left[len(left) - room :] if len(left) > room else left
            text = (left + value + right)[:WINDOW].ljust(WINDOW)
            ids[k] = symbols(text)
            if kind >= 0:
                end = min(len(left) + len(value), WINDOW)
                tags[k, len(left) : end] = 2 + 2 * kind
                tags[k, len(left)] = 1 + 2 * kind
        return ids, tags


def new_tagger(seed: int = 0, hidden: int = 40) -> Tagger:
    tags = 1 + 2 * len(KINDS)
    allowed = np.ones((tags, tags), bool)
    for kind in range(len(KINDS)):
        allowed[:, 2 + 2 * kind] = False
        allowed[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = True
    return Tagger(tags, allowed, hidden, seed)


def train(docs: DataFrame, sample: int = 1000, windows: int = 16_000, steps: int = 700) -> Tagger:
    """A tagger from base spans of about ``sample`` documents at most."""

    def contexts(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                spans = base_spans(text)
                for kind, start, end in spans[:20]:
                    rows.append((text[max(0, start - WINDOW) : start], text[end : end + WINDOW], kind, text[start:end][:WINDOW]))
                m = TRIGGER.search(text)
                if not spans and m:
                    rows.append((text[max(0, m.start() - WINDOW) : m.start()], text[m.start() : m.start() + WINDOW], -1, ""))
            yield pd.DataFrame(rows, columns=["before", "after", "kind", "value"])

    some, span = docs.where(F.col("text").rlike("[0-9@]")), 1 << 30
    share = int(span * min(1.0, sample / max(some.count(), 1)))
    some = some.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)) < share).select("text").distinct()  # equal rows are drawn together
    rows = some.mapInPandas(contexts, "before string, after string, kind int, value string").collect()
    found = sorted(set(map(tuple, rows))) or [("the text before it. ", " and the text after it, as it goes on.", -1, "")]
    tagger = new_tagger()
    tagger.fit(*Labelled().windows(found, windows), steps=steps, batch=64)
    return tagger


def proposals(tagger: Tagger, texts: list[str], known: list[list[tuple[int, int, int]]], batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """What the tagger adds to each text's known spans."""
    jobs = []
    for k, text in enumerate(texts):
        covered = sorted((a, b) for _, a, b in known[k])
        slots, i = set(), 0
        for m in TRIGGER.finditer(text):
            p = m.start()
            while i < len(covered) and covered[i][1] <= p:
                i += 1
            if i < len(covered) and covered[i][0] <= p:
                continue
            slots.update(range(max(0, (p - WINDOW) // STRIDE + 1), p // STRIDE + 1))
        jobs += [(k, s) for s in sorted(slots)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for at in range(0, len(jobs), batch):
        part = jobs[at : at + batch]
        tags = tagger.decode(np.stack([symbols(texts[k][s * STRIDE : s * STRIDE + WINDOW].ljust(WINDOW)) for k, s in part]))
        for row in np.flatnonzero(tags.any(1)).tolist():
            k, slot = part[row]
            t, base = tags[row], slot * STRIDE
            for a in np.flatnonzero(t % 2 == 1).tolist():
                kind, b = (int(t[a]) - 1) // 2, a + 1
                while b < WINDOW and t[b] == t[a] + 1:
                    b += 1
                centre = (a + b) // 2
                if (centre >= STRIDE // 2 or slot == 0) and centre < WINDOW - STRIDE // 2:
                    out[k].append((kind, base + a, min(base + b, len(texts[k]))))
    for k, spans in enumerate(out):
        kept, taken = [], sorted((a, b) for _, a, b in known[k])
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            part = trimmed(kind, texts[k], a, b)
            if part and all(part[1] <= x or part[0] >= y for x, y in taken):
                a, b = part
                kept.append((kind, a, b))
                taken.append((a, b))
        out[k] = kept
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, sample: int = 1000, windows: int = 16_000, steps: int = 700) -> DataFrame:
    """A row per document: base counts and digest, and all spans, as ``kind:start:end``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tagger = docs.sparkSession.sparkContext.broadcast(train(docs, sample, windows, steps))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) and TRIGGER.search(t) else "" for t in pdf["text"]]
            base = [base_spans(t) if t else [] for t in texts]
            added = proposals(tagger.value, texts, base)
            counts = [[sum(k == kind for k, _, _ in spans) for spans in base] for kind in range(len(KINDS))]
            digest = [hashlib.sha256(joined(s).encode()).hexdigest() if s else nothing for s in base]
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pd.DataFrame(dict(zip(names, [pdf["doc_id"], *counts, digest, [joined(a + b) for a, b in zip(base, added)]])))

    return docs.mapInPandas(run, RESULT)

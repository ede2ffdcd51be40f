"""Plain versions of the operators, for small tables, and a table with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASCII_UPPER = {b: a for a, b in ASCII_LOWER.items()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def prose(rng: random.Random, n: int) -> str:
    pool = [f"{a}{b}{c}" for a in ("an", "the", "ou", "ré", "st") for b in ("er", "nd", "io", "ea", "li") for c in ("", "th", "ing", "ß")]
    out = [rng.choice(pool) + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    return "".join(w + ("\n" if i % 13 == 12 else " ") for i, w in enumerate(out)).strip()


def items(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    return [(i, prose(rng, 25)) for i in range(6)] + [(6, None), (7, ""), (8, "too short"), (None, prose(rng, 30)), (3, prose(rng, 22))]


def documents(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages and lines, benchmark passages, nulls, blanks, a long text and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (60, 90, 140, 200, 55, 300)]
    passage, line = prose(rng, 40).replace("\n", " "), prose(rng, 12).replace("\n", " ")
    texts: list[str | None] = list(base)
    texts += [base[1], base[1], base[2] + " tail", base[3].replace(" ", "  ", 1)]
    for k in (1, 2, 5, 9):  # near copies with k words replaced
        w = base[5].split(" ")
        for i in rng.sample(range(len(w)), k):
            w[i] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 50)} {passage} {prose(rng, 30)}" for _ in range(4)]
    texts += [f"{passage} {passage} {prose(rng, 10)}", f"{line}\n{prose(rng, 60)}", f"{prose(rng, 60)}\n{line}\n{line}", f"{prose(rng, 60)}\n{line.replace(' ', ' extra ', 1)}"]
    for _, item in items()[:3]:
        texts.append(f"{prose(rng, 40)} {item} {prose(rng, 20)}")
        texts.append(f"{prose(rng, 40)} {item[:30]}xy{item[31:]} {prose(rng, 20)}".translate(ASCII_UPPER))
    texts += [None, "", "   \n\t ", "one", "Two words", "a b c", "it's 123 <|endoftext|>x <|ENDOFTEXT|> \x1c é é 日本 \U0001f600　z", "### $$$ |||" * 30, "SHOUT!! " * 60]
    texts += ["same same same " * 40, prose(rng, 4000), "x" * 5000, "\x0b".join(["w"] * 70)]
    langs = ["en", "fr", None, ""]
    rows = [(i, t, langs[i % 4], f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], rows[1], (None, prose(rng, 70), "en", None, None), (None, base[0], None, None, 1), (2, prose(rng, 65), "en", "s0", 5)]


def quality(text: str | None) -> tuple:
    """The base counts, base_failed and kept."""
    w, text = words(text), text or ""
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if triples[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    n, chars, symbols, duplicates = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(repeated) > 50 * n
    letters, capitals = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    bad = 10 * symbols > n or chars < 3 * n or chars > 12 * n or duplicates >= 3 and 10 * duplicates > 3 * len(lines)
    bad = bad or 10 * sum(any(c.isalpha() for c in x) for x in w) < 8 * n or 10 * capitals > 4 * letters or 4 * sum(c in "!?" for c in text) > n
    return n, chars, symbols, duplicates, len(repeated), failed, not (failed or bad)


def before_all(doc_id: int | None) -> int:
    return -(2**63) if doc_id is None else doc_id


def repeats(rows: list[tuple], window: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) of each row."""
    first: dict = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key, at = tuple(w[i : i + window]), (before_all(doc_id), i)
            first[key] = min(first.get(key, at), at)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (before_all(doc_id), i) for k in range(window)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def one_edit(a: tuple, b: tuple) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def line_dedup(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_removed, text) of each row."""
    first: dict = {}
    for doc_id, text in rows:
        for i, x in enumerate((text or "").split("\n")):
            if w := tuple(words(x)):
                first[w] = min(first.get(w, (before_all(doc_id), i)), (before_all(doc_id), i))
    long = [w for w in first if len(w) >= 8]
    beaten = {a for a in long for b in long if first[b] < first[a] and one_edit(a, b)}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for i, x in enumerate(lines) if not (w := tuple(words(x))) or (w not in beaten and first[w] == (before_all(doc_id), i))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def near(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = []
    for doc_id, text in rows:
        w = words((text or "").translate(ASCII_LOWER))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append((doc_id, grams))
    parent = {d: d for d, _ in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return [(d, len(x), (d if not x else top(d)) if d is not None else None, d is None or not x or top(d) == d) for d, x in sets]


def substring_distance(item: str, text: str) -> int:
    column, best = list(range(len(item) + 1)), len(item)
    for c in text:
        before = column[0]
        for i in range(1, len(item) + 1):
            here = min(column[i] + 1, column[i - 1] + 1, before + (item[i - 1] != c))
            before, column[i] = column[i], here
        best = min(best, column[-1])
    return best


def contaminated(rows: list[tuple], benchmark: list[tuple], rate: float = 0.08, min_words: int = 5) -> Counter:
    """(doc_id, item_id, distance) of each row and distinct item. Far texts are left out by their shared word pairs."""
    found: Counter = Counter()
    wanted = {(i, " ".join(words((t or "").lower()))) for i, t in benchmark}
    for doc_id, text in rows:
        plain = " ".join(words((text or "").lower()))
        for item_id, item in wanted:
            if item.count(" ") + 1 < min_words:
                if item and f" {item} " in f" {plain} ":
                    found[doc_id, item_id, 0] += 1
                continue
            if sum(item[i : i + 8] in plain for i in range(0, len(item) - 8, 8)) >= 2 and (d := substring_distance(item, plain)) <= int(len(item) * rate):
                found[doc_id, item_id, d] += 1
    return found


def groups(pairs) -> dict:
    out = defaultdict(list)
    for key, value in pairs:
        out[key].append(value)
    return out

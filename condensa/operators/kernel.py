"""Greedy matching and rewriting of one text, for Arrow batches.

Resolving overlaps, applying matches one by one behind a similarity gate, and
rematching a rewritten text are folds with a state that Column expressions can
only nest; these run here, once over each text, and nothing is shuffled. What a
Column expression can say (profiles, ratios, quality, estimates) stays in
``functions``; the few of these that an engine needs inside its loop are repeated
here and tested to agree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

import ahocorasick

from .. import lexicons as lx

#: what splits tokens, as in the Column expressions
BLANK = " \t\n\x0b\f\r"
TOKEN, BLANKS = re.compile(f"[^{BLANK}]+"), re.compile(f"[{BLANK}]+")
#: characters looked at one by one for a token's border before whole-text searches are used
NEAR = 256

#: (position, minus priority, rule id, size, short form, confidence, rule) of an occurrence; in the order of resolution
Match = tuple[int, int, int, int, str, float, dict]


def lowered(text: str) -> str:
    """Lower case with every character in its place: one whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


class Rules:
    """A bounded list of rules compiled to one automaton: a text is read once, however many rules there are."""

    def __init__(self, rules: Iterable[dict]):
        self.rules = list(rules)
        groups: dict[str, list[dict]] = {}
        for r in self.rules:
            if r["original"]:
                groups.setdefault(lowered(r["original"]), []).append(r)
        self.automaton = ahocorasick.Automaton()
        for key, own in groups.items():
            self.automaton.add_word(key, (len(key), own))
        if groups:
            self.automaton.make_automaton()
        self.empty = not groups

    def occurrences(self, text: str):
        """(position, rule) of every occurrence, letter case aside, overlapping ones too; a word rule needs borders."""
        if self.empty:
            return
        n = len(text)
        for last, (size, own) in self.automaton.iter(lowered(text)):
            at = last + 1 - size
            whole = None
            for r in own:
                if r["pattern_type"] == "word":
                    if whole is None:
                        whole = not (at and text[at - 1].isalnum()) and not (last + 1 < n and text[last + 1].isalnum())
                    if not whole:
                        continue
                yield at, size, r

    def matches(self, text: str) -> list[Match]:
        return [(at, -(r["priority"] or 0), r["id"], size, r["compressed"], confidence(text, at, size, r), r) for at, size, r in self.occurrences(text)]


def confidence(text: str, at: int, size: int, rule: dict) -> float:
    around = text[max(0, at - 20) : at + size + 20].lower()
    technical = rule["domain"] in ("web-development", "general") and any(w in around for w in lx.TECH_CONTEXT)
    return min(1.0, 0.8 + min(0.2, (rule["priority"] or 0) / 5000) + (rule["success_rate"] or 0.0) * 0.1 + (0.1 if technical else 0.0))


def resolve(matches: Iterable[Match]) -> list[Match]:
    """By position, then priority: one free of overlaps is taken; else it replaces the one it overlaps if much better."""
    taken: list[Match] = []
    for m in sorted(matches, key=lambda m: m[:3]):
        if not taken or taken[-1][0] + taken[-1][3] <= m[0]:
            taken.append(m)
        elif m[1] < taken[-1][1] * 1.2 or m[5] > taken[-1][5] + 0.2:
            taken[-1] = m
    return taken


def splice(text: str, matches: Iterable[Match]) -> str:
    """The text with disjoint matches in order of position replaced."""
    out, at = [], 0
    for m in matches:
        out += (text[at : m[0]], m[4])
        at = m[0] + m[3]
    return "".join(out) + text[at:]


def rewrite(text: str, rules: Rules) -> str:
    return splice(text, resolve(rules.matches(text)))


# --- similarity of a text and its rewrites ----------------------------------------


def word_jaccard(a: str, b: str) -> float:
    x, y = set(tokens(a.lower())), set(tokens(b.lower()))
    return 1.0 if not x and not y else len(x & y) / len(x | y) if x and y else 0.0


class Overlap:
    """The word overlap of a text with rewrites of it, kept up to date by the words around each change."""

    def __init__(self, text: str):
        self.text = text
        self.base = Counter(tokens(text.lower()))
        self.now = self.base.copy()
        self.common, self.new = len(self.base), 0

    def _add(self, words: list[str], by: int) -> None:
        for w in words:
            before = self.now[w]
            after = self.now[w] = before + by
            if (before > 0) != (after > 0):
                if w in self.base:
                    self.common += by
                else:
                    self.new += by

    def share(self) -> float:
        size = len(self.base) + self.new
        if not size:
            return 1.0
        return self.common / size if self.base and self.common + self.new else 0.0

    def change(self, text: str, at: int, size: int, short: str) -> tuple[list[str], list[str]]:
        """Notes that size characters at a place of the current text become short; gives what undo needs."""
        begin, end = _border(text, at, -1), _border(text, at + size, 1)
        gone, come = tokens(text[begin:end].lower()), tokens((text[begin:at] + short + text[at + size : end]).lower())
        self._add(gone, -1)
        self._add(come, 1)
        return gone, come

    def undo(self, change: tuple[list[str], list[str]]) -> None:
        self._add(change[1], -1)
        self._add(change[0], 1)


def _border(text: str, at: int, step: int) -> int:
    """The nearest place at or before (step -1) or at or after (step 1) a place where a token begins or ends."""
    for _ in range(NEAR):
        if step < 0 and (at == 0 or text[at - 1] in BLANK) or step > 0 and (at >= len(text) or text[at] in BLANK):
            return at
        at += step
    if step < 0:
        return max(text.rfind(c, 0, at) for c in BLANK) + 1
    m = BLANKS.search(text, at)
    return m.start() if m else len(text)


# --- rewrites -----------------------------------------------------------------------


def _alternatives(words: list[str], after: str) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)" + after, re.IGNORECASE)


_PHRASES = [(re.compile(rf"(?<!\w){re.escape(a)}(?!\w)", re.IGNORECASE), b) for a, b in lx.PHRASES]
_PASSIVE = [(re.compile(rf"(?<!\w){p.replace(chr(92) + 'w', '[A-Za-z0-9_]')}(?!\w)", re.IGNORECASE), b.replace("$1", r"\1")) for p, b in lx.PASSIVE]
_FILLERS, _MODIFIERS = _alternatives(lx.FILLERS, f"[{BLANK}]*"), _alternatives(lx.MODIFIERS, f"[{BLANK}]+")
_DROPPABLE, _VOWELS = set(lx.DROPPABLE), re.compile("[aeiou]", re.IGNORECASE)
_LINE_END = re.compile(" +(?=[\n\r\x85  ]|\\Z)")


def drop_function_words(words: list[str]) -> list[str]:
    out = []
    for i, w in enumerate(words):
        low = w.lower()
        if i and low in _DROPPABLE and not (i + 1 < len(words) and words[i + 1].lower() in lx.KEPT_BEFORE.get(low, ())):
            continue
        out.append(w)
    return out


def squeeze(word: str) -> str:
    if len(word) <= 6 or not word.isalpha():
        return word
    low = word.lower()
    if sum(c in low for c in lx.CLUSTERS) < 2:
        return word
    short = word[:2] + _VOWELS.sub("", word[2:-2]) + word[-2:]
    return word if len(short) < max(4.0, len(word) * 0.6) else short


def drop_adjacent_repeats(words: list[str]) -> list[str]:
    low = [w.lower() for w in words]
    return [w for i, w in enumerate(words) if not i or low[i] != low[i - 1]]


def plain_stages(text: str) -> str:
    """The extreme engine's stages after its rules."""
    text = " ".join(drop_function_words(tokens(text)))
    for pattern, short in _PHRASES:
        text = pattern.sub(lambda m, s=short: s, text)
    text = " ".join(drop_adjacent_repeats([squeeze(w) for w in tokens(text)]))
    for pattern, short in _PASSIVE:
        text = pattern.sub(short, text)
    return _MODIFIERS.sub("", _FILLERS.sub("", text))


def one_line(text: str) -> str:
    return BLANKS.sub(" ", text).strip(" ")


def tidy_lines(text: str) -> str:
    text = re.sub(f"\n[{BLANK}]*\n[{BLANK}]*\n+", "\n\n", text)
    return _LINE_END.sub("", re.sub(" +", " ", text))


def segments(text: str) -> list[tuple[str, bool]]:
    """(text, whether it may be rewritten) of the blocks between empty lines and fences."""
    out, held, code = [], [], False
    for line in text.split("\n"):
        fence = line.lstrip(" ").startswith("```")
        if fence or (not code and not line.strip(BLANK)):
            if held:
                out.append(("\n".join(held), not code))
                held = []
            code ^= fence
        else:
            held.append(line)
    if held:
        out.append(("\n".join(held), not code))
    return out


# --- profiles -----------------------------------------------------------------------


def sensitivity(text: str) -> float:
    low = text.lower()
    words = tokens(low)
    if not words:
        return 0.0
    n = len(words)
    technical = sum(any(s in w for s in lx.TECH) for w in words) / n
    count = text.count
    marks = count(".") + count("!") + count("?") + count(",") * 0.5 + count(";") * 0.8 + (count("(") + count(")")) * 0.3 + (count("-") + count("*") + count("•")) * 0.6
    formal = sum(s in low for s in lx.FORMAL)
    return min(1.0, technical * 0.4 + min(1.0, marks / n * 10) * 0.3 + min(0.3, formal / n * 10))


def potential(text: str) -> float:
    low = text.lower()
    words = tokens(low)
    if not words:
        return 0.0
    n = len(words)
    long_words = sum(len(w) > 8 for w in tokens(text))
    repeats = sum(size * sum(c > 1 for c in Counter(zip(*(words[k:] for k in range(size)))).values()) for size in (2, 3, 4))
    verbose = sum(low.count(v) for v in lx.VERBOSE)
    return min(1.0, long_words / n * 0.3 + repeats / n * 0.3 + verbose / n * 0.2 + (1 - len(set(words)) / n) * 0.2)


def estimate(text: str, short: str) -> float:
    """The extreme engine's own estimate of quality."""
    a = set(tokens(text.lower()))
    kept = len(a & set(tokens(short.lower()))) / len(a) if a else 1.0
    return min(1.0, 0.7 * kept + 0.3 * (1 - ratio(text, short)))


def ratio(text: str, short: str) -> float:
    return len(short) / len(text) if text else 1.0


# --- engines ------------------------------------------------------------------------


class Engines:
    """The engines for a rule list and a level, as functions of one text.

    The semantic and extreme engines take a domain's own rules only, as a scan of
    the rule table with a domain does; the advanced one adds the general ones.
    """

    def __init__(self, rules: list[dict], level: str = "balanced", domain: str | None = None, threshold: float = 0.9, target: float = 0.6):
        own = [r for r in rules if not domain or r["domain"] == domain]
        self.level, self.threshold, self.target = level, threshold, target
        self.strong = Rules(r for r in own if r["success_rate"] >= 0.8 or r["priority"] >= 800)
        self.safe = Rules(r for r in own if r["priority"] >= 900 and r["success_rate"] >= 0.95)
        self.bands = [Rules(r for r in own if low <= r["priority"] <= high) for _, low, high in lx.BANDS]
        self.all = Rules(rules)

    def _joined(self, text: str, each: Callable[[str], str]) -> str:
        return "\n".join(each(s) if free else s for s, free in segments(text))

    def _gated(self, text: str) -> str:
        """Matches by confidence, each applied if it alone and with those before it keeps the text like the original."""
        found = sorted(resolve(self.strong.matches(text)), key=lambda m: (-m[5], m[0]))
        like, chosen = Overlap(text), []
        for m in found:
            original = text[m[0] : m[0] + m[3]]
            change = like.change(text, text.find(original), m[3], m[4])
            if like.share() >= self.threshold:
                chosen.append((original, m[4]))
            like.undo(change)
        now = text
        for original, short in chosen:
            at = now.find(original)
            if at < 0:
                continue
            change = like.change(now, at, len(original), short)
            if like.share() >= self.threshold:
                now = now[:at] + short + now[at + len(original) :]
            else:
                like.undo(change)
        return now

    def semantic(self, text: str) -> str:
        """Gated rewrites of each segment behind a gate over the whole; else the safest rules alone."""
        out = self._joined(text, self._gated)
        if word_jaccard(text, out) >= self.threshold:
            return out
        return splice(text, [m for m in resolve(self.safe.matches(text)) if m[5] >= 0.9])

    def _extreme_segment(self, text: str) -> str:
        for band in self.bands:
            text = rewrite(text, band)
        return plain_stages(text)

    def extreme(self, text: str) -> str:
        return one_line(self._joined(text, self._extreme_segment))

    def strategy(self, text: str) -> str:
        sensitive, free = sensitivity(text), potential(text)
        if sensitive > 0.7:
            return "semantic"
        if (free > 0.8 and sensitive < 0.4) or self.level == "aggressive":
            return "extreme"
        return "semantic" if self.level == "light" else "hybrid"

    def mixed(self, text: str) -> str:
        """Each segment by the engine that suits it."""
        return tidy_lines(self._joined(text, lambda s: self.semantic(s) if sensitivity(s) > 0.6 else self.extreme(s)))

    def hybrid(self, text: str) -> tuple[str, str]:
        """Strategy, engine, refinement: the text and the name of the engine it is from."""
        name = self.strategy(text)
        out = {"semantic": self.semantic, "extreme": self.extreme, "hybrid": self.mixed}[name](text)
        r = ratio(text, out)
        if not ((r > 0.8 and self.target < 0.7) or r < 0.3 or estimate(text, out) < 0.75):
            return out, name
        if r > 0.8:
            other = self.extreme(text)
            return (other, "extreme") if len(other) < len(out) else (out, name)
        return (self.semantic(text), "semantic") if r < 0.3 else (out, name)

    def candidates(self, text: str) -> tuple[str, str, str, float | None, float | None]:
        """For the advanced engine: rewritten with all matches, with the most confident four fifths, with the safest, and the mean confidence of the first two."""
        found = resolve(self.all.matches(text))
        best = sorted(found, key=lambda m: (-m[5], m[0]))[: int(len(found) * 0.8)]
        safe = [m for m in found if m[6]["priority"] >= 800 and m[6]["success_rate"] >= 0.8 and m[5] >= 0.9]
        mean = lambda ms: sum(m[5] for m in ms) / len(ms) if ms else None
        return splice(text, found), splice(text, sorted(best, key=lambda m: m[0])), splice(text, safe), mean(found), mean(best)

"""Trigger patterns: what each needs a text to hold, an index of many over those words, and matching that no pattern can stall.

Patterns are those of Python's ``re``, searched in any case. From a pattern's parse three things are derived: its required words (a match holds one of them), the
same pattern in the syntax of a matcher that takes time in proportion to the text, and the texts for which that form means the same.
"""

from __future__ import annotations

import re
import signal
import threading
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MAX_PATTERN

#: Required words of a pattern at most, and the least length of one.
ALTERNATIVES, SHORTEST = 16, 2
#: Seconds that a pattern beyond the linear matcher may take for one text; what is not found by then counts as not there.
PATIENCE = 1.0

# The characters that Python takes for an ASCII letter in any case, beside that letter's own two.
_ALL = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]))
_LIKE = {ord(c): next(a for a in "abcdefghijklmnopqrstuvwxyz" if re.match(a, c, re.IGNORECASE)) for c in re.findall("[a-z]", _ALL, re.IGNORECASE)}


def folded(text: str) -> str:
    """The text with every character that matches an ASCII letter in any case as that letter, in lower case."""
    return text.lower() if text.isascii() else text.translate(_LIKE).lower()


def _plain(code: int) -> str | None:
    """A character of a required word: one that only itself, or the other case of an ASCII letter, matches."""
    c = chr(code)
    if code < 128:
        return c.lower()
    return c if c.lower() == c.upper() == c.casefold() and code not in _LIKE else None


class _Beyond(Exception):
    """The linear matcher cannot say it."""


@dataclass(frozen=True)
class Pattern:
    """``words``: None, or what every match holds one of. ``linear``: the pattern for the linear matcher, or None. ``narrow``: it means the same for ASCII texts only."""

    text: str
    words: frozenset[str] | None
    linear: str | None
    narrow: bool


# ---------------------------------------------------------------- required words


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """Of two sets that each must be met, the one that says more: its shortest word is longer, or it is smaller."""
    rank = lambda s: (min(map(len, s)), -len(s)) if s else (-1, 0)
    return a if rank(a) >= rank(b) else b


def _needs(seq) -> tuple[set[str] | None, set[str] | None]:
    """All that a sequence can match (None: too much to list), and the best set of words of which it holds one."""
    run: set[str] | None = {""}
    best: set[str] | None = None
    whole = True
    for op, arg in seq:
        exact, need = _needs_one(op, arg)
        if exact is not None and run is not None and len(run) * len(exact) <= ALTERNATIVES:
            run = {a + b for a in run for b in exact}
            continue
        whole = False
        best = _better(_better(best, run), need)
        run = exact if exact is not None and len(exact) <= ALTERNATIVES else {""}
    return (run if whole else None), _better(best, run)


def _needs_one(op, arg) -> tuple[set[str] | None, set[str] | None]:
    if op is K.LITERAL:
        c = _plain(arg)
        return ({c}, {c}) if c is not None else (None, None)
    if op is K.IN:
        some = {_plain(v) if k is K.LITERAL else None for k, v in arg}
        return (some, some) if None not in some and len(some) <= 4 else (None, None)
    if op is K.BRANCH:
        parts = [_needs(x) for x in arg[1]]
        exact = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
        need = set().union(*(n for _, n in parts)) if all(n for _, n in parts) else None
        small = lambda s: s if s is not None and len(s) <= ALTERNATIVES else None
        return small(exact), small(need)
    if op is K.SUBPATTERN:
        return _needs(arg[3])
    if op is K.ATOMIC_GROUP:
        return None, _needs(arg)[1]
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, need = _needs(inner)
        if low == high == 1:
            return exact, need
        return None, need if low >= 1 else None
    if op is K.AT:
        return {""}, None
    if op is K.ASSERT:
        return {""}, None
    if op is K.ASSERT_NOT:
        return {""}, None
    return None, None


# ---------------------------------------------------------------- the linear form

_UNICODE = {K.CATEGORY_DIGIT: r"\p{Nd}", K.CATEGORY_SPACE: r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", K.CATEGORY_WORD: r"\p{L}\p{N}_"}
_NEGATED = {K.CATEGORY_NOT_DIGIT: K.CATEGORY_DIGIT, K.CATEGORY_NOT_SPACE: K.CATEGORY_SPACE, K.CATEGORY_NOT_WORD: K.CATEGORY_WORD}


class _Writer:
    def __init__(self, flags: int):
        self.flags, self.narrow = flags, False
        if flags & ~(re.IGNORECASE | re.UNICODE | re.DOTALL | re.MULTILINE | re.VERBOSE):
            raise _Beyond

    def char(self, code: int) -> str:
        if _plain(code) is None:
            raise _Beyond  # letters of other scripts have their own rules of case
        return f"\\x{{{code:x}}}"

    def members(self, items) -> str:
        out = ""
        for op, arg in items:
            if op is K.LITERAL:
                out += self.char(arg)
            elif op is K.RANGE and arg[1] < 128:
                out += f"\\x{{{arg[0]:x}}}-\\x{{{arg[1]:x}}}"
            elif op is K.CATEGORY and arg in _UNICODE:
                self.narrow = True
                out += _UNICODE[arg]
            elif op is K.CATEGORY and len(items) == 1 and arg in _NEGATED:
                self.narrow = True
                return "^" + _UNICODE[_NEGATED[arg]]
            else:
                raise _Beyond
        return out

    def sequence(self, seq, last: bool) -> str:
        items = list(seq)
        return "".join(self.one(op, arg, last and n == len(items) - 1) for n, (op, arg) in enumerate(items))

    def one(self, op, arg, last: bool) -> str:
        """``last``: nothing of the pattern comes after it."""
        if op is K.LITERAL:
            return self.char(arg)
        if op is K.NOT_LITERAL:
            return f"[^{self.char(arg)}]"
        if op is K.ANY:
            return "(?s:.)" if self.flags & re.DOTALL else "[^\\n]"
        if op is K.IN:
            negated = arg[0][0] is K.NEGATE
            body = self.members(arg[negated:])
            if negated and body.startswith("^"):
                return f"[{body[1:]}]"
            return f"[{'^' if negated else ''}{body}]"
        if op is K.BRANCH:
            return f"(?:{'|'.join(self.sequence(x, last) for x in arg[1])})"
        if op is K.SUBPATTERN and not arg[1] and not arg[2]:
            return f"(?:{self.sequence(arg[3], last)})"
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            if low == 0 and high == K.MAXREPEAT:
                times = "*"
            elif low == 1 and high == K.MAXREPEAT:
                times = "+"
            else:
                times = f"{{{low},{'' if high == K.MAXREPEAT else high}}}"
            return f"(?:{self.sequence(inner, False)}){times}"
        if op is K.AT:
            if arg is K.AT_BEGINNING_STRING or (arg is K.AT_BEGINNING and not self.flags & re.MULTILINE):
                return "\\A"
            if arg is K.AT_BEGINNING:
                return "(?m:^)"
            if arg is K.AT_END_STRING:
                return "\\z"
            if arg is K.AT_END and self.flags & re.MULTILINE:
                return "(?m:$)"
            if arg is K.AT_END and last:
                return "(?:\\n?\\z)"  # a match that ends there: before a last line end, or at the end
            if arg is K.AT_BOUNDARY:
                self.narrow = True
                return "\\b"
        raise _Beyond


def analysed(text: str | None) -> Pattern | None:
    """What is known of a pattern; None if it is too long or does not compile, so that it never matches."""
    if text is None or len(text) > MAX_PATTERN:
        return None
    try:
        re.compile(text, re.IGNORECASE)
        tree = parser.parse(text, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None
    linear, narrow = None, True
    try:
        writer = _Writer(tree.state.flags)
        linear, narrow = writer.sequence(tree, True), writer.narrow
        pc.match_substring_regex(pa.array([""]), linear, ignore_case=True)
    except (_Beyond, pa.ArrowInvalid, RecursionError):
        linear = None
    try:
        words = _needs(tree)[1]
    except RecursionError:
        words = None
    good = words and min(map(len, words)) >= SHORTEST
    return Pattern(text, frozenset(words) if good else None, linear, narrow)


def found(pattern: Pattern, texts: pa.Array) -> list[bool]:
    """Which texts (not null) hold a match. The linear matcher sees all that it can; a pattern, or a text, that is beyond it has ``PATIENCE`` seconds a text."""
    if pattern.linear is not None and not pattern.narrow:
        wide = pa.array([t if t.isascii() else t.translate(_LIKE) for t in texts.to_pylist()], pa.string())
        return pc.match_substring_regex(wide, pattern.linear, ignore_case=True).to_pylist()
    if pattern.linear is not None:
        ascii_only = pc.string_is_ascii(texts)
        out = pc.match_substring_regex(pc.if_else(ascii_only, texts, ""), pattern.linear, ignore_case=True).to_pylist()
        rest = [i for i, plain in enumerate(ascii_only.to_pylist()) if not plain]
    else:
        out, rest = [False] * len(texts), range(len(texts))
    for i in rest:
        out[i] = _searched(pattern.text, texts[i].as_py())
    return out


class _Late(Exception):
    pass


def _stop(*_):
    raise _Late


def _searched(pattern: str, text: str) -> bool:
    """Python's own matcher, which looks for signals on its way. Only a main thread can be signalled; in any other the search runs to its end."""
    timed = threading.current_thread() is threading.main_thread()
    before = signal.signal(signal.SIGALRM, _stop) if timed else None
    try:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, PATIENCE)
        return re.search(pattern, text, re.IGNORECASE) is not None
    except (_Late, RecursionError, MemoryError):
        return False
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)


ANALYSIS = pa.struct([("text", pa.string()), ("words", pa.list_(pa.string())), ("linear", pa.string()), ("narrow", pa.bool_())])


def pattern_analysis(pattern: str | Column) -> Column:
    """What is known of each pattern, as a struct; null where it is null or never matches."""

    def run(texts: pa.Array) -> pa.Array:
        known = {t: analysed(t) for t in set(texts.to_pylist())}
        as_row = lambda p: None if p is None else {"text": p.text, "words": p.words and sorted(p.words), "linear": p.linear, "narrow": p.narrow}
        return pa.array([as_row(known[t]) for t in texts.to_pylist()], ANALYSIS)

    return F.arrow_udf(run, "text string, words array<string>, linear string, narrow boolean")(pattern)


# ---------------------------------------------------------------- many patterns


class PatternIndex:
    """Rules by the words that their patterns need. A rule is (place in the order of preference, a tuple; key; what is known of its pattern, or None); a text asks with its keys.

    One automaton finds the words of all rules in a text; only rules with a word there, of one of the text's keys, are tested. Rules without a pattern hit every
    text of their key, and bar what comes after the k-th of them.
    """

    def __init__(self, rules: list[tuple[tuple, tuple, Pattern | None]], k: int):
        import ahocorasick

        self.k, self.tested = k, 0
        self.patterns: dict[tuple, Pattern] = {}
        self.always: dict[tuple, list[tuple]] = {}
        self.wordless: dict[tuple, list[tuple]] = {}
        by_word: dict[str, dict[tuple, list[tuple]]] = {}
        for place, key, p in sorted(rules, key=lambda r: r[0]):
            if p is None:
                if len(held := self.always.setdefault(key, [])) < k:
                    held.append(place)
                continue
            self.patterns[place] = p
            if p.words is None:
                self.wordless.setdefault(key, []).append(place)
            for w in p.words or ():
                by_word.setdefault(w, {}).setdefault(key, []).append(place)
        self._words = ahocorasick.Automaton()
        for w, places in by_word.items():
            self._words.add_word(w, places)
        if by_word:
            self._words.make_automaton()
        self._any = bool(by_word)

    def candidates(self, text: str, keys: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """The rules that hit whatever the text is, k at most, and those that have to be tested."""
        sure = sorted(p for key in keys for p in self.always.get(key, ()))[: self.k]
        bar = sure[-1] if len(sure) == self.k else None
        lists = [self.wordless[key] for key in keys if key in self.wordless]
        if self._any:
            met = {id(places): places for _, places in self._words.iter(folded(text))}
            lists += [places[key] for places in met.values() for key in keys if key in places]
        maybe = {p for some in lists for p in some if bar is None or p < bar}
        return sure, sorted(maybe)

    def match(self, texts: list[str], keys: list[list[tuple]]) -> list[list[tuple]]:
        """For each text the places of its first k hits."""
        hits, asked = [], {}
        for n, (text, own) in enumerate(zip(texts, keys, strict=True)):
            sure, maybe = self.candidates(text, own)
            hits.append(sure)
            for place in maybe:
                asked.setdefault(place, []).append(n)
        column = pa.array(texts, pa.string())
        for place in sorted(asked):  # the best first, so that full texts drop out
            rows = [n for n in asked[place] if len(hits[n]) < self.k or place < hits[n][-1]]
            if rows:
                self.tested += len(rows)
                for n, hit in zip(rows, found(self.patterns[place], column.take(pa.array(rows))), strict=True):
                    if hit:
                        hits[n] = sorted([*hits[n], place])[: self.k]
        return hits

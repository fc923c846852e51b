"""Secret scan by one combined automaton over bytes.

The rules' regular expressions are compiled here: to one nondeterministic
automaton, then by subset construction and minimisation to transition arrays.
A text's UTF-8 bytes pass once through the combined automaton, whose accepting
states tell for all rules where a match has begun; within a match the
rule's own reverse arrays give the leftmost start and its own forward arrays the
longest end, and lengths are checked.  A rule is parted into a head, which
begins a match, and a body that extends it: bodies are runs that several
rules can be in at once, and their subsets, unlike the heads', would multiply in
the combined automaton.  Each rule's matches are leftmost and don't overlap, also
with matches that fail their length.

Rules' regexes know literals, ``.``, classes and negated classes, groups, ``|``,
``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``, escapes of one character that is no letter or
digit, and ``\\xHH``; anything else is an error.

Defined cases: a null text is empty and has no spans; a very long text passes in
one go, byte by byte, and only its spans are kept; spans that begin at one place
go by the order of the rules; a null id stays null; repeated rows are scanned one
by one; an empty table gives an empty result.  Only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.arrow import map_rows


@dataclass(frozen=True)
class Rule:
    """``head`` then ``body``: the head begins a match, and the body, which may ask for more, ends it.

    ``least`` is the length that a match needs, counted from the last
    ``count_from`` mark: the whole match, or its trailing run of ``run`` bytes.
    """

    kind: str
    head: str
    body: str
    least: int = 0
    run: str = ""
    any_case: bool = False


VALUE = "[A-Za-z0-9+/_.=-]"
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?" + VALUE, VALUE + "*", 6, VALUE, True),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]*", 20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]*", 24),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]", "[A-Za-z0-9]*", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9]", "[A-Za-z0-9-]*", 20),
    Rule("cloud", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 39),
    Rule("payment", "[sr]k_(live|test)_[A-Za-z0-9]", "[A-Za-z0-9]*", 24),
    Rule("signed", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]", "[A-Za-z0-9_-]*(\\.[A-Za-z0-9_-]+)?", 30),
    Rule("private", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", "", 0),
    Rule("bearer", "Bearer\\x20+[A-Za-z0-9]", "[A-Za-z0-9._~+/=-]*", 20, "[A-Za-z0-9._~+/=-]"),
    Rule("temporary", "ASIA[A-Z0-9]", "[A-Z0-9]*", 20),
    Rule("merchant", "amzn\\.mws\\.[0-9a-f]", "[0-9a-f-]*", 40),
    Rule("storage", "AccountKey=[A-Za-z0-9+/]", "[A-Za-z0-9+/=]*", 97),
    Rule("fine-grained", "github_pat_[A-Za-z0-9_]", "[A-Za-z0-9_]*", 40),
    Rule("lab", "gl(pat|dt|rt|ptt|ft|soat|agent|cbt|imt)-[A-Za-z0-9_-]", "[A-Za-z0-9_.-]*", 25),
    Rule("app", "xapp-[0-9]-[A-Za-z0-9]", "[A-Za-z0-9-]*", 30),
    Rule("webhook", "hooks\\.slack\\.com/services/T[A-Z0-9]", "[A-Za-z0-9/]*", 60),
    Rule("oauth", "ya29\\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 30),
    Rule("client", "GOCSPX-[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 35),
    Rule("endpoint", "whsec_[A-Za-z0-9+/]", "[A-Za-z0-9+/=]*", 38),
    Rule("square", "sq0(atp|csp|idp)-[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 29),
    Rule("wave", "FLWSECK(_TEST)?-[A-Za-z0-9]", "[A-Za-z0-9-]*", 40),
    Rule("post", "EZ[AT]K[A-Za-z0-9]", "[A-Za-z0-9]*", 58),
    Rule("shop", "shp(at|ca|pa|ss)_[a-fA-F0-9]", "[a-fA-F0-9]*", 38),
    Rule("model", "sk-(proj|svcacct|admin)-[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 48),
    Rule("hub", "hf_[A-Za-z]", "[A-Za-z0-9]*", 37),
    Rule("replica", "r8_[A-Za-z0-9]", "[A-Za-z0-9]*", 40),
    Rule("npm", "npm_[A-Za-z0-9]", "[A-Za-z0-9]*", 40),
    Rule("pypi", "pypi-AgE[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 70),
    Rule("gems", "rubygems_[0-9a-f]", "[0-9a-f]*", 57),
    Rule("nuget", "oy2[a-z0-9]", "[a-z0-9]*", 46),
    Rule("docker", "dckr_(pat|oat)_[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 36),
    Rule("ocean", "do[opr]_v1_[0-9a-f]", "[0-9a-f]*", 71),
    Rule("vault", "hv[sbr]\\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 28),
    Rule("bricks", "dapi[0-9a-f]", "[0-9a-f]*(-[0-9])?", 36),
    Rule("grafana", "gl(sa|c)_[A-Za-z0-9+/]", "[A-Za-z0-9+/=_]*", 40),
    Rule("relic", "NRAK-[A-Z0-9]", "[A-Z0-9]*", 32),
    Rule("sentry", "sntry[su]_[A-Za-z0-9+/]", "[A-Za-z0-9+/=_]*", 60),
    Rule("scale", "pscale_(tkn|pw|oauth)_[A-Za-z0-9_.-]", "[A-Za-z0-9_.-]*", 40),
    Rule("atlas", "ATATT3[A-Za-z0-9_=-]", "[A-Za-z0-9_=-]*", 100),
    Rule("linear", "lin_(api|oauth)_[A-Za-z0-9]", "[A-Za-z0-9]*", 48),
    Rule("notes", "ntn_[A-Za-z0-9]", "[A-Za-z0-9]*", 46),
    Rule("design", "figd_[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 45),
    Rule("postman", "PMAK-[0-9a-f]", "[0-9a-f-]*", 60),
    Rule("content", "CFPAT-[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 49),
    Rule("build", "bkua_[a-z0-9]", "[a-z0-9]*", 45),
    Rule("mail", "SG\\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]*\\.[A-Za-z0-9_-]+", 60),
    Rule("mailing", "xkeysib-[0-9a-f]", "[0-9a-f]*(-[A-Za-z0-9]+)?", 80),
    Rule("gun", "key-[0-9a-f]", "[0-9a-f]*", 36),
    Rule("account", "(AC|SK)[0-9a-f]", "[0-9a-f]*", 34),
    Rule("age", "AGE-SECRET-KEY-1[A-Z0-9]", "[A-Z0-9]*", 74),
    Rule("pgp", "-----BEGIN PGP PRIVATE KEY BLOCK-----", "", 0),
    Rule("putty", "PuTTY-User-Key-File-[0-9]:", "", 0),
    Rule("database", "(postgres(ql)?|mysql|mariadb|mongodb(\\+srv)?|rediss?|amqps?)://", "[A-Za-z0-9_.%-]*:[A-Za-z0-9_.%!$&*+=~-]+@[A-Za-z0-9.:/_-]+", 0),
    Rule("basic", "Basic\\x20+[A-Za-z0-9+/]", "[A-Za-z0-9+/]*=?=?", 24, "[A-Za-z0-9+/=]"),
)


class Parser:
    """A regular expression's syntax tree: ('byte', set), ('cat', [..]), ('or', [..]), ('star'|'plus'|'opt', x)."""

    def __init__(self, source: str, any_case: bool = False):
        self.s, self.i, self.any_case = source, 0, any_case

    def parse(self):
        tree = self.either()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in {self.s!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while (c := self.peek()) and c not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def fail(self, what: str):
        raise ValueError(f"{what} at {self.i} in {self.s!r}")

    def repeated(self):
        x = self.single()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            x = self.times(x) if c == "{" else ({"?": "opt", "*": "star", "+": "plus"}[c], x)
            if self.peek() in ("?", "+") and c != "?":
                self.fail("lazy or possessive repeats")
        return x

    def times(self, x):
        """``{m}``, ``{m,}`` or ``{m,n}`` copies."""
        to = self.s.find("}", self.i)
        low, comma, high = self.s[self.i : to].partition(",")
        if to < 0 or not low.isdigit() or high and (not high.isdigit() or int(high) < int(low)):
            self.fail("a count that is none")
        self.i = to + 1
        rest = [("star", x)] if comma and not high else [("opt", x)] * (int(high) - int(low) if high else 0)
        return ("cat", [x] * int(low) + rest)

    def char(self) -> int:
        c = self.peek() or self.fail("the end")
        self.i += 1
        if c == "\\":
            c = self.peek() or self.fail("the end")
            self.i += 1
            if c == "x":
                digits = self.s[self.i : self.i + 2]
                if not re.fullmatch("[0-9a-fA-F]{2}", digits):
                    self.fail("two hexadecimal digits missing")
                self.i += 2
                return int(digits, 16)
            if c.isalnum():
                self.fail(f"the unknown escape {c!r}")
        if ord(c) > 127:
            self.fail("a character outside ASCII")
        return ord(c)

    def fold(self, found: set[int], but: bool = False):
        if self.any_case:
            found |= {b ^ 32 for b in found if 65 <= (b & ~32) <= 90}
        return ("byte", frozenset(range(256)) - found if but else frozenset(found))

    def single(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            if self.peek() == "?":
                if self.s[self.i : self.i + 2] != "?:":
                    self.fail("a group of unknown kind")
                self.i += 2
            x = self.either()
            if self.peek() != ")":
                self.fail("an open group")
            self.i += 1
            return x
        if c == "[":
            self.i += 1
            but = self.peek() == "^"
            self.i += but
            found: set[int] = set()
            while self.peek() != "]":
                low = high = self.char()
                if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", ""):
                    self.i += 1
                    high = self.char()
                if high < low:
                    self.fail("a range that is none")
                found |= {*range(low, high + 1)}
            self.i += 1
            return self.fold(found, but)
        if c == ".":
            self.i += 1
            return ("byte", frozenset(range(256)) - {10})
        if c in "^$?*+{":
            self.fail(f"{c!r} as syntax that is unknown here")
        return self.fold({self.char()})


class Nfa:
    """States with byte moves and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, backwards: bool = False) -> int:
        """The end state of ``tree`` laid from ``start``."""
        kind, x = tree
        if kind == "byte":
            end = self.state()
            self.moves[start].append((x, end))
            return end
        if kind == "cat":
            for part in reversed(x) if backwards else x:
                start = self.add(part, start, backwards)
            return start
        if kind == "or":
            end = self.state()
            for part in x:
                self.empty[self.add(part, self.fork(start), backwards)].append(end)
            return end
        inner = self.fork(start)
        last, end = self.add(x, inner, backwards), self.state()
        self.empty[last].append(end)
        if kind != "plus":
            self.empty[inner].append(end)
        if kind != "opt":
            self.empty[last].append(inner)
        return end

    def fork(self, start: int) -> int:
        new = self.state()
        self.empty[start].append(new)
        return new

    def closure(self, states) -> frozenset:
        todo, seen = [*states], set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """``table[state + byte]`` is the next state, a multiple of 256; states from ``accepting`` up accept ``rules[state]``."""

    table: array
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]]
    dead: int


def determinise(nfa: Nfa, starts, ends: dict[int, int], floating: bool = False) -> Dfa:
    """Subset construction, then minimisation.  ``ends``: accepting state to rule.  ``floating``: matches begin anywhere."""
    classes: dict[tuple, int] = {}
    sets = list({m for ms in nfa.moves for m, _ in ms})
    of_byte = [classes.setdefault(tuple(b in m for m in sets), len(classes)) for b in range(256)]
    sample = [of_byte.index(k) for k in range(len(classes))]
    holds = {m: [k for k, b in enumerate(sample) if b in m] for m in sets}
    base = nfa.closure(starts)
    reach = [nfa.closure([t]) for t in range(len(nfa.moves))]

    def moves(states) -> dict[int, set[int]]:
        out: dict[int, set[int]] = {}
        for s in states:
            for m, t in nfa.moves[s]:
                for k in holds[m]:
                    out.setdefault(k, set()).update(reach[t])
        return out

    # Where matches begin anywhere, the start's states are in every subset, so their moves are laid once.
    always = base if floating else frozenset()
    from_base = moves(always)
    common = [frozenset(from_base.get(k, ())) | always for k in range(len(classes))]
    number, order, rows = {base: 0}, [base], []
    for now in order:
        row, more = [], moves(now - always)
        for k, to in enumerate(common):
            if k in more:
                to = to | more[k]
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    accepts = [tuple(sorted({ends[s] for s in x if s in ends})) for x in order]
    ids: dict = {}
    block = np.array([ids.setdefault(a, len(ids)) for a in accepts])
    grid, n = np.array(rows), len(ids)
    while True:  # split blocks until all states of a block move alike
        kinds, block = np.unique(np.column_stack([block, block[grid]]), axis=0, return_inverse=True)
        if len(kinds) == n:
            break
        n = len(kinds)
    block = block.ravel().tolist()
    first = {b: i for i, b in reversed([*enumerate(block)])}
    ranked = sorted(first, key=lambda b: (bool(accepts[first[b]]), first[b]))
    at = {b: k * 256 for k, b in enumerate(ranked)}
    table = array("i", [at[block[rows[first[b]][of_byte[c]]]] for b in ranked for c in range(256)])
    rules = {at[b]: accepts[first[b]] for b in ranked}
    dead = next((at[b] for b in ranked if not accepts[first[b]] and all(block[t] == b for t in rows[first[b]])), -1)
    return Dfa(table, at[block[0]], min((s for s, a in rules.items() if a), default=len(table)), rules, dead)


class Scanner:
    """The automata of a set of rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [(Parser(r.head, r.any_case).parse(), Parser(r.body, r.any_case).parse()) for r in rules]
        nfa, starts, ends = Nfa(), [], {}
        for k, (head, _) in enumerate(trees):
            starts.append(nfa.state())
            ends[nfa.add(head, starts[-1])] = k
        self.combined = determinise(nfa, starts, ends, floating=True)
        self.combined_rows = list(self.combined.table)
        self.forward, self.backward, self.runs = [], [], []
        for r, (head, body) in zip(rules, trees):
            one = Nfa()
            start = one.state()
            self.forward.append(determinise(one, [start], {one.add(("cat", [head, body]), start): 0}))
            one = Nfa()
            start = one.state()
            self.backward.append(determinise(one, [start], {one.add(head, start, backwards=True): 0}))
            self.runs.append(frozenset(Parser(r.run).parse()[1][0][1]) if r.run else None)

    @staticmethod
    def longest(dfa: Dfa, data: bytes, at: int, stop: int, step: int) -> int:
        """Where the longest match from ``at`` towards ``stop`` ends, or -1."""
        s, found, table = dfa.start, -1, dfa.table
        while at != stop:
            s = table[s + data[at if step > 0 else at - 1]]
            at += step
            if s >= dfa.accepting:
                found = at
            elif s == dfa.dead:
                break
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``start, rule, end`` in bytes, sorted."""
        table, limit, accept, s = self.combined_rows, self.combined.accepting, self.combined.rules, self.combined.start
        used, out = [0] * len(self.rules), []
        for at, b in enumerate(data, 1):
            s = table[s + b]
            if s >= limit:
                for k in accept[s]:
                    if at > used[k] and (start := self.longest(self.backward[k], data, at, used[k], -1)) >= 0:
                        end = self.longest(self.forward[k], data, start, len(data), 1)
                        used[k] = max(used[k], end)
                        if end >= 0 and self.long_enough(k, data, start, end):
                            out.append((start, k, end))
        return sorted(out)

    def long_enough(self, k: int, data: bytes, start: int, end: int) -> bool:
        rule, run = self.rules[k], self.runs[k]
        if run is None:
            return end - start >= rule.least
        n = 0
        while n < rule.least and end - n > start and data[end - n - 1] in run:
            n += 1
        return n >= rule.least and self.value_start(k, data, start) <= end - rule.least

    def value_start(self, k: int, data: bytes, start: int) -> int:
        """Where the value of a rule with a run begins: at the last byte of its shortest head."""
        dfa, s, at = self.forward[k], self.forward[k].start, start
        while s < dfa.accepting:
            s = dfa.table[s + data[at]]
            at += 1
        return at - 1

    def text_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """``start, rule, end`` in code points."""
        data = (text or "").encode()
        found = self.spans(data)
        if not found or len(data) == len(text):
            return found
        places: dict[int, int] = {}
        last = chars = 0
        for p in sorted({p for start, _, end in found for p in (start, end)}):
            chars += len(data[last:p].decode())
            last = p
            places[p] = chars
        return sorted((places[a], k, places[b]) for a, k, b in found)


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One set of automata for each worker process."""
    return Scanner(rules)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The id and ``spans array<struct<start:bigint,rule:int,kind:string,end:bigint>>`` of every row, by start, then rule."""
    id_type = df.schema[id_col].dataType.simpleString()

    def fn(key, text):
        yield key, [{"start": a, "rule": k, "kind": rules[k].kind, "end": b} for a, k, b in scanner(rules).text_spans(text)]

    return map_rows(df.select(id_col, text_col), fn, f"`{id_col}` {id_type}, spans array<struct<start:bigint,rule:int,kind:string,end:bigint>>")


def redact_text(text: str | None, rules: tuple[Rule, ...] = RULES) -> str | None:
    """The text with each stretch of overlapping spans replaced by ``[SECRET]``; null stays null."""
    spans = scanner(rules).text_spans(text)
    if not spans:
        return text
    out, at = [], 0
    low, high = spans[0][0], spans[0][2]
    for start, _, end in [*spans[1:], (len(text) + 1, 0, 0)]:
        if start >= high:
            out += [text[at:low], "[SECRET]"]
            at, low, high = high, start, end
        else:
            high = max(high, end)
    return "".join(out) + text[at:]

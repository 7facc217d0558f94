"""A generalised LL recogniser over a graph-structured stack, with error recovery.

Grammars are plain data: nonterminal to its alternatives, an alternative being a
tuple of symbols; what is no nonterminal is a terminal, compared with the kind of
the token. Any context-free grammar will do, left-recursive and ambiguous ones too:
a descriptor is (slot, stack node, position), every descriptor is worked once at its
least cost, and stack nodes are shared by all parses that wait for the same
nonterminal at the same place, so the work is at most cubic in the tokens and about
linear for these grammars.

Error recovery: when no parse goes on and the start symbol does not reach the end,
the parses that got furthest are taken up again, at a cost of one each: a closing
symbol that is awaited there is taken as given, or the token there is passed over.
All spans found are kept with their least cost, so a broken text still gives its
sound parts.
"""

from __future__ import annotations

from collections.abc import Sequence

Grammar = dict[str, list[tuple[str, ...]]]


class Parser:
    """Prepared slots of one grammar; ``closers`` are the terminals that recovery may take as given, ``skips`` says whether it may pass tokens over."""

    def __init__(self, grammar: Grammar, start: str, closers: Sequence[str] = (), skips: bool = True):
        self.grammar, self.start, self.closers, self.skips = grammar, start, frozenset(closers), skips
        self.first: dict[str, set[str]] = {n: set() for n in grammar}
        self.empty: set[str] = set()
        self.follow: dict[str, set[str]] = {n: set() for n in grammar}
        changed = True
        while changed:
            changed = False
            for head, alternatives in grammar.items():
                for body in alternatives:
                    before = len(self.first[head]), head in self.empty
                    self.first[head] |= self._starts(body)
                    if all(s in self.empty for s in body):
                        self.empty.add(head)
                    changed |= before != (len(self.first[head]), head in self.empty)
        changed = True
        while changed:
            changed = False
            for head, alternatives in grammar.items():
                for body in alternatives:
                    for k, s in enumerate(body):
                        if s in grammar:
                            before = len(self.follow[s])
                            self.follow[s] |= self._starts(body[k + 1 :])
                            if all(x in self.empty for x in body[k + 1 :]):
                                self.follow[s] |= self.follow[head]
                            changed |= before != len(self.follow[s])
        #: Alternatives of a nonterminal by the kind of the next token; None holds those to fall back on.
        self.table: dict[str, dict[str | None, list[int]]] = {}
        for head, alternatives in grammar.items():
            row: dict[str | None, list[int]] = {}
            for k, body in enumerate(alternatives):
                vanishing = all(s in self.empty for s in body)
                for kind in self._starts(body) | (self.follow[head] if vanishing else set()):
                    row.setdefault(kind, []).append(k)
            row[None] = [k for k, body in enumerate(alternatives) if all(s in self.empty for s in body)] or list(range(len(alternatives)))
            self.table[head] = row

    def _starts(self, body: Sequence[str]) -> set[str]:
        out: set[str] = set()
        for s in body:
            if s not in self.grammar:
                return out | {s}
            out |= self.first[s]
            if s not in self.empty:
                break
        return out

    def spans(self, kinds: Sequence[str], whole: bool = True) -> dict[tuple[str, int], dict[int, int]]:
        """(nonterminal, begin) to {end: least cost} for everything reached from the start symbol.

        ``whole``: recover until the start symbol spans all tokens; otherwise no recovery is tried once it spans any.
        """
        grammar, table, n = self.grammar, self.table, len(kinds)
        done: dict[tuple[str, int], dict[int, int]] = {}
        waiting: dict[tuple[str, int], list[tuple[str, int, int, tuple[str, int], int]]] = {}
        todo: list[tuple[str, int, int, tuple[str, int], int, int]] = []
        seen: dict[tuple[str, int, int, tuple[str, int], int], int] = {}
        stuck: dict[int, list[tuple[str, int, int, tuple[str, int], int]]] = {}
        passed: dict[int, list[tuple[str, int, int, tuple[str, int], int]]] = {}

        def add(head: str, alternative: int, dot: int, node: tuple[str, int], at: int, cost: int) -> None:
            key = head, alternative, dot, node, at
            if cost < seen.get(key, 1 << 30):
                seen[key] = cost
                todo.append((*key, cost))

        def call(name: str, at: int) -> tuple[str, int]:
            node = name, at
            if node not in waiting:
                waiting[node] = []
                done[node] = {}
                row = table[name]
                for k in row.get(kinds[at] if at < n else "", row[None]):
                    add(name, k, 0, node, at, 0)
            return node

        top = call(self.start, 0)
        while True:
            while todo:
                head, alternative, dot, node, at, cost = todo.pop()
                body = grammar[head][alternative]
                if dot == len(body):
                    if cost < done[node].get(at, 1 << 30):
                        done[node][at] = cost
                        for h, k, d, up, base in waiting[node]:
                            add(h, k, d, up, at, base + cost)
                    continue
                symbol = body[dot]
                if symbol in grammar:
                    below = call(symbol, at)
                    edge = head, alternative, dot + 1, node, cost
                    if edge not in waiting[below]:
                        waiting[below].append(edge)
                        for end, inner in list(done[below].items()):
                            add(head, alternative, dot + 1, node, end, cost + inner)
                elif at < n and kinds[at] == symbol:
                    add(head, alternative, dot + 1, node, at + 1, cost)
                else:
                    stuck.setdefault(at, []).append((head, alternative, dot, node, cost))
            if (n in done[top] if whole else done[top]) or not (stuck or passed):
                return done
            # What can be taken as given is tried before a token is passed over.
            at = max(stuck or passed)
            here = stuck.pop(at, [])
            given = [d for d in here if grammar[d[0]][d[1]][d[2]] in self.closers]
            for head, alternative, dot, node, cost in given:
                add(head, alternative, dot + 1, node, at, cost + 1)
            if given:
                passed.setdefault(at, []).extend(here)
                continue
            for head, alternative, dot, node, cost in here + passed.pop(at, []):
                if at < n and self.skips:
                    add(head, alternative, dot, node, at + 1, cost + 1)

    def pieces(self, kinds: Sequence[str], wanted: Sequence[str]) -> list[tuple[str, int, int]]:
        """Longest spans of the wanted nonterminals that do not overlap, from left to right."""
        found = self.spans(kinds)
        out: list[tuple[str, int, int]] = []
        best: dict[int, tuple[int, int, str]] = {}
        for (name, begin), ends in found.items():
            if name in wanted and ends:
                end = max(ends)
                if end > begin:
                    best[begin] = max(best.get(begin, (0, 0, "")), (end, -wanted.index(name), name))
        at = 0
        while at < len(kinds):
            if at in best:
                end, _, name = best[at]
                out.append((name, at, end))
                at = end
            else:
                at += 1
        return out

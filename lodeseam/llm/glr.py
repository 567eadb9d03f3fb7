"""A table-driven generalized LR recognizer, and the generator of its tables from a grammar in text.

A grammar is lines "name: alternative | alternative"; 'quoted' words and UPPER names are tokens, others nonterminals;
x? x* x+ and (...) have their usual meaning, `x % 'sep'` is one or more x separated by sep. The tables are SLR(1); where
they conflict, the recognizer follows every action at once on a graph of stacks that share what they have in common, so
that any context-free grammar is recognized exactly. Where one stack is alive it runs as a plain LR parser.
"""

from __future__ import annotations

import re
from collections import defaultdict

END = "$end"


class Grammar:
    def __init__(self, text: str, start: str | None = None) -> None:
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self.by_name: dict[str, list[int]] = defaultdict(list)
        self._helpers: dict[tuple, str] = {}
        joined = re.sub(r"\n[ \t]+", " ", re.sub(r"(?m)^\s*//.*\n?", "", text))
        names = []
        for line in joined.split("\n"):
            if line.strip():
                name, _, body = line.partition(":")
                names.append(name.strip())
                self._tokens = re.findall(r"'[^']+'|[A-Za-z_]\w*|[()|?*+%]", body)
                self._at = 0
                for alternative in self._alternatives():
                    self._add(name.strip(), alternative)
        self.start = start or names[0]
        self._add("$start", (self.start,))
        self.tokens = {s for _, rhs in self.rules for s in rhs if s not in self.by_name}
        unknown = {t for t in self.tokens if not t.isupper() and not t.startswith("\0")}
        assert not unknown, f"undefined: {sorted(unknown)}"
        self._build()

    # -- reading -------------------------------------------------------------------------------------------------

    def _add(self, name: str, rhs: tuple[str, ...]) -> None:
        if (name, rhs) not in [(self.rules[i]) for i in self.by_name[name]]:
            self.by_name[name].append(len(self.rules))
            self.rules.append((name, rhs))

    def _helper(self, key: tuple, alternatives) -> str:
        if key not in self._helpers:
            self._helpers[key] = name = f"_{len(self._helpers)}"
            for a in alternatives(name):
                self._add(name, a)
        return self._helpers[key]

    def _alternatives(self) -> list[tuple[str, ...]]:
        out = [self._sequence()]
        while self._at < len(self._tokens) and self._tokens[self._at] == "|":
            self._at += 1
            out.append(self._sequence())
        return [x for group in out for x in group]

    def _sequence(self) -> list[tuple[str, ...]]:
        """The alternatives of one sequence, optional parts written out."""
        out: list[tuple[str, ...]] = [()]
        while self._at < len(self._tokens) and self._tokens[self._at] not in "|)":
            token = self._tokens[self._at]
            self._at += 1
            if token == "(":
                inner = self._alternatives()
                self._at += 1
                item = self._helper(("group", tuple(inner)), lambda _, inner=inner: inner)
            else:
                item = "\0" + token[1:-1] if token[0] == "'" else token
            optional = False
            while self._at < len(self._tokens) and self._tokens[self._at] in ("?", "*", "+", "%"):
                mark = self._tokens[self._at]
                self._at += 1
                if mark == "%":
                    sep = self._tokens[self._at]
                    sep = "\0" + sep[1:-1] if sep[0] == "'" else sep
                    self._at += 1
                    item = self._helper(("sep", item, sep), lambda me, i=item, s=sep: [(i,), (me, s, i)])
                elif mark == "?":
                    optional = True
                else:
                    optional |= mark == "*"
                    item = self._helper(("many", item), lambda me, i=item: [(i,), (me, i)])
            out = [a + (item,) for a in out] + (out if optional else [])
        return out

    # -- tables --------------------------------------------------------------------------------------------------

    def _build(self) -> None:
        nullable: set[str] = set()
        first: dict[str, set[str]] = defaultdict(set)
        follow: dict[str, set[str]] = defaultdict(set)
        for t in self.tokens:
            first[t] = {t}
        follow["$start"] = {END}
        changed = True
        while changed:
            changed = False
            for name, rhs in self.rules:
                before = len(first[name]), name in nullable
                for s in rhs:
                    first[name] |= first[s]
                    if s not in nullable:
                        break
                else:
                    nullable.add(name)
                changed |= before != (len(first[name]), name in nullable)
        changed = True
        while changed:
            changed = False
            for name, rhs in self.rules:
                trailer = follow[name]
                for s in reversed(rhs):
                    if s in self.by_name:
                        before = len(follow[s])
                        follow[s] |= trailer
                        changed |= before != len(follow[s])
                    trailer = trailer | first[s] if s in nullable else first[s]
        top = self.by_name["$start"][0]

        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            items, seen = list(kernel), set()
            for rule, dot in items:
                rhs = self.rules[rule][1]
                if dot < len(rhs) and rhs[dot] in self.by_name and rhs[dot] not in seen:
                    seen.add(rhs[dot])
                    items += [(r, 0) for r in self.by_name[rhs[dot]] if (r, 0) not in kernel]
            return items

        states: dict[frozenset, int] = {frozenset([(top, 0)]): 0}
        queue = list(states)
        self.actions: list[dict[str, tuple]] = []
        self.goto: list[dict[str, int]] = []
        for kernel in queue:
            shifts: dict[str, set] = defaultdict(set)
            reduces: dict[str, list[int]] = defaultdict(list)
            for rule, dot in closure(kernel):
                name, rhs = self.rules[rule]
                if dot < len(rhs):
                    shifts[rhs[dot]].add((rule, dot + 1))
                else:
                    for t in follow[name]:
                        reduces[t].append(rule)
            actions: dict[str, tuple] = {}
            goto: dict[str, int] = {}
            for symbol, items in shifts.items():
                key = frozenset(items)
                if key not in states:
                    states[key] = len(states)
                    queue.append(key)
                if symbol in self.by_name:
                    goto[symbol] = states[key]
                else:
                    actions[symbol] = (states[key], ())
            for t, rules in reduces.items():
                if t == END and top in rules:
                    actions[t] = (-1, ())  # accept
                    rules = [r for r in rules if r != top]
                    if not rules:
                        continue
                actions[t] = (actions.get(t, (None,))[0], tuple((len(self.rules[r][1]), self.rules[r][0]) for r in rules))
            self.actions.append(actions)
            self.goto.append(goto)

        self.landings: dict[tuple, int] = {}

    def landing(self, base: int, name: str, token: str) -> int:
        """The state after `name` on `base`, chains of reductions of one symbol that the token leads to being gone through."""
        state = self.goto[base][name]
        while True:
            action = self.actions[state].get(token)
            if not action or action[0] is not None or len(action[1]) != 1 or action[1][0][0] != 1:
                return state
            state = self.goto[base][action[1][0][1]]

    def conflicts(self) -> int:
        return sum(len(a[1]) + (a[0] is not None) > 1 for row in self.actions for a in row.values())


class Parser:
    """One run over one text: feed() tokens in order. A stack node is [state, parent, more parents or None]."""

    def __init__(self, grammar: Grammar) -> None:
        self.g = grammar
        self.heads: list[list] = [[0, None, None]]
        self.done = False

    def feed(self, token: str) -> bool:
        """Whether some reading goes on with the token; if none does, nothing has changed."""
        if len(self.heads) == 1:
            actions, landings = self.g.actions, self.g.landings
            node = self.heads[0]
            while True:
                action = actions[node[0]].get(token)
                if action is None:
                    return False
                state, reduces = action
                if not reduces:
                    if state == -1:
                        self.done = True
                    else:
                        self.heads = [[state, node, None]]
                    return True
                if state is not None or len(reduces) > 1:
                    break
                length, name = reduces[0]
                base = node
                while length and base[2] is None:
                    base = base[1]
                    length -= 1
                if length:
                    break
                key = (base[0], name, token)
                landing = landings.get(key)
                if landing is None:
                    landing = landings[key] = self.g.landing(*key)
                node = [landing, base, None]
            return self._feed_all(token, [node])
        return self._feed_all(token, self.heads)

    def _feed_all(self, token: str, heads: list[list]) -> bool:
        actions, goto = self.g.actions, self.g.goto
        active: dict[int, list] = {}
        for h in heads:
            active[h[0]] = [h[0], h[1], list(h[2]) if h[2] else None]
        again = True
        while again:
            again = False
            for node in list(active.values()):
                action = actions[node[0]].get(token)
                if not action:
                    continue
                for length, name in action[1]:
                    bases = [node]
                    for _ in range(length):
                        step: dict[int, list] = {}
                        for b in bases:
                            step[id(b[1])] = b[1]
                            for extra in b[2] or ():
                                step[id(extra)] = extra
                        bases = list(step.values())
                    for base in bases:
                        target = goto[base[0]].get(name)
                        if target is None:
                            continue
                        known = active.get(target)
                        if known is None:
                            active[target] = [target, base, None]
                            again = True
                        elif known[1] is not base and not (known[2] and any(x is base for x in known[2])):
                            if known[2] is None:
                                known[2] = []
                            known[2].append(base)
                            again = True
        shifted: dict[int, list] = {}
        accepted = False
        for node in active.values():
            action = actions[node[0]].get(token)
            if not action or action[0] is None:
                continue
            if action[0] == -1:
                accepted = True
                continue
            known = shifted.get(action[0])
            if known is None:
                shifted[action[0]] = [action[0], node, None]
            else:
                known[2] = [*(known[2] or []), node]
        if accepted:
            self.done = True
            return True
        if not shifted:
            return False
        self.heads = list(shifted.values())
        return True

"""Weighted finite-state transducers over small alphabets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Transducer:
    """Deterministic arcs ``(state, symbol) -> (next state, symbol written, weight)``.
    A symbol without an arc is copied with weight 1 and leaves the state."""

    arcs: dict
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def states(self) -> set:
        return {self.start, *(s for s, _ in self.arcs), *(a[0] for a in self.arcs.values())}

    def then(self, other: Transducer, alphabet: str) -> Transducer:
        """Composition: ``other`` reads what this one writes, weights multiply.
        Only pairs of states that the alphabet can reach are built."""
        start, arcs = (self.start, other.start), {}
        todo, seen = [start], {start}
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                a, middle, u = self.step(state[0], symbol)
                b, out, v = other.step(state[1], middle)
                arcs[state, symbol] = (a, b), out, u * v
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(arcs, start)

    def run(self, symbols: str) -> list[tuple[str, float]]:
        """What is written for each symbol, with its weight."""
        state, out = self.start, []
        for s in symbols:
            state, written, weight = self.step(state, s)
            out.append((written, weight))
        return out

"""What a judge has read before each step: structures that walk a trajectory once (used
inside scoring tasks)."""

from collections import deque

import numpy as np

#: cost of a step that is verbatim anyway: no room ever takes it
FIXED = 1 << 50


class CostTree:
    """Costs of steps in order, with minima over runs of 64, 64**2, ... of them, so that the
    newest step whose cost fits is found in a few looks at any length."""

    FAN = 64

    def __init__(self) -> None:
        self.n, self.levels = 0, [np.full(self.FAN, FIXED, np.int64)]

    @classmethod
    def of(cls, costs: np.ndarray) -> "CostTree":
        """All at once."""
        tree = cls()
        tree.n, tree.levels = len(costs), []
        while not tree.levels or len(tree.levels[-1]) > cls.FAN:
            full = np.full(-(-max(1, len(costs)) // cls.FAN) * cls.FAN, FIXED, np.int64)
            full[:len(costs)] = costs
            tree.levels.append(full)
            costs = full.reshape(-1, cls.FAN).min(1)
        return tree

    def append(self, cost: int) -> None:
        at, level = self.n, 0
        while True:
            if level == len(self.levels):
                below = self.levels[-1]
                self.levels.append(np.full(self.FAN, FIXED, np.int64))
                self.levels[level][:len(below) // self.FAN] = below.reshape(-1, self.FAN).min(1)
            elif at == len(self.levels[level]):
                self.levels[level] = np.concatenate([self.levels[level], np.full_like(self.levels[level], FIXED)])
            here = self.levels[level]
            here[at] = min(here[at], cost)
            if level == len(self.levels) - 1 and len(here) <= self.FAN:
                break
            at, level = at // self.FAN, level + 1
        self.n += 1

    def newest(self, before: int, room: int) -> int:
        """The greatest place under ``before`` whose cost is at most ``room``, or -1."""
        for level, costs in enumerate(self.levels):
            start = 0 if level == len(self.levels) - 1 else before // self.FAN * self.FAN
            fits = np.flatnonzero(costs[start:before] <= room)
            if len(fits):
                at = start + int(fits[-1])
                while level:
                    level, first = level - 1, at * self.FAN
                    at = first + int(np.flatnonzero(self.levels[level][first:first + self.FAN] <= room)[-1])
                return at
            before //= self.FAN
        return -1

    def upgrade(self, room: int, first: int = 0, run: int = 256) -> tuple[list[int], int]:
        """The greedy choice among the steps from ``first`` on, newest first, passing over
        what does not fit: places and the room that is left."""
        taken, before = [], self.n
        while (at := self.newest(before, room)) >= first:
            low = max(first, at + 1 - run)
            spent = np.cumsum(self.levels[0][low:at + 1][::-1])
            k = int(np.argmax(np.append(spent > room, True)))
            taken += range(at, at - k, -1)
            room -= int(spent[k - 1])
            before = at + 1 - k
        return taken, room


class GrowingPrefix:
    """The prefix of one trajectory, step by step. Without a budget it only grows. With
    one, a step that would pass it makes the retention policy rebuild the prefix to
    ``goal`` characters: coordination verbatim, the newest other steps verbatim while
    they fit, the rest as headers. Texts are optional: lengths alone decide."""

    def __init__(self, head: int, budget: int | None, goal: int, head_text: str | None = None):
        self.budget, self.goal, self.head_text = budget, goal, head_text
        self.costs, self.base, self.others = CostTree(), head, 0
        self.lines, self.full, self.kept = [], [], []
        self.used, self.rebuilds, self.demoted, self.text = head, 0, 0, head_text or ""

    def add(self, full: int, short: int, coord: bool, texts: tuple[str, str] | None = None
            ) -> tuple[int, int, int, bool]:
        if self.budget is not None:  # what a later rebuild chooses from
            self.costs.append(FIXED if coord else full - short)
            self.base += full if coord else short
            self.others += not coord
            if texts:
                self.lines.append(texts[0] if coord else texts[1])
                self.full.append(texts[0])
        if self.budget is None or self.used + full <= self.budget:
            self.used += full
            if texts:
                self.text += texts[0]
            return self.used, self.rebuilds, self.demoted, False
        self.kept, left = self.costs.upgrade(self.goal - self.base)
        self.used, self.demoted = self.goal - left, self.others - len(self.kept)
        if texts:
            parts = self.lines.copy()
            for i in self.kept:
                parts[i] = self.full[i]
            self.text = (self.head_text or "") + "".join(parts)
        self.rebuilds += 1
        return self.used, self.rebuilds, self.demoted, True


class SlidingPrefix:
    """The last ``n`` steps under a budget: steps enter at one end and leave at the other,
    and the retention policy chooses among those inside. Texts of n steps are held."""

    def __init__(self, n: int, budget: int, head: str):
        self.n, self.budget, self.head = n, budget, head
        self.costs, self.base, self.inside = CostTree(), len(head), deque()

    def enter(self, full: str, short: str, coord: bool) -> None:
        if len(self.inside) == self.n:
            self.base -= len(self.inside.popleft()[0])
        self.costs.append(FIXED if coord else len(full) - len(short))
        line = full if coord else short
        self.inside.append((line, full, coord))
        self.base += len(line)

    def add(self, full: str, short: str, coord: bool) -> tuple[str, int]:
        """The text with this step last, and the number of demoted steps."""
        self.enter(full, short, coord)
        first = self.costs.n - len(self.inside)
        kept, _ = self.costs.upgrade(self.budget - self.base, first)
        kept = {i - first for i in kept}
        parts = [f if i in kept else line for i, (line, f, _) in enumerate(self.inside)]
        return self.head + "".join(parts), sum(not c for _, _, c in self.inside) - len(kept)


class BlankedPrefix:
    """A prefix whose oldest steps are blanked up to a mark that only moves on. Held are the
    blanked text and, past the mark, both forms of each step."""

    def __init__(self, text: str, mark: int):
        self.text, self.mark, self.open = text, mark, deque()

    def push(self, full: str, blank: str) -> None:
        self.open.append((full, blank))

    def move(self, mark: int) -> str:
        """Blank the steps below ``mark`` and give the whole text."""
        gone = [self.open.popleft()[1] for _ in range(mark - self.mark)]
        self.text, self.mark = self.text + "".join(gone), mark
        return self.text + "".join(full for full, _ in self.open)

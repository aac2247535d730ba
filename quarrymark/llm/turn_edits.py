"""The cheapest edits that give a conversation legal roles, found row by row with a state of fixed size.

Legal role initials are ``(s?(ua)+)?``.  What has been written so far is one of four states: nothing, the system row, a user row,
an assistant row.  An edit string leads from one state to exactly one other, so the rows written follow from the edit string
alone.  For every state the cheapest edit string that ends in it is kept, ties by ASCII; strings that end with an edit of the same
row are never prefixes of each other, so their order, kept as a rank, settles every later tie.

Costs differ by a bounded amount between states, so a step depends on few distinct situations and is looked up (``_step``).  Of
each row only the number of its step is kept, four bytes; a long conversation writes them to the shared folder in blocks and reads
the blocks back from the last to the first.  The checksum of the repaired rows runs along, one per state.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterator

from quarrymark.llm.shared_files import place

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
SPILL = 1 << 20

Situation = tuple[tuple[int | None, ...], tuple[int, ...]]
START: Situation = ((0, None, None, None), (0, 0, 0, 0))


def _inserted(state: int) -> list[tuple[str, int, int]]:
    """Edits, cost and state after no, one or two inserted rows; more never pay, two rows lead back to the same state."""
    one = NEXT[state]
    found = [("", 0, state), ("I", INSERT, one)]
    return found if state in (USER, ASSISTANT) else [*found, ("II", 2 * INSERT, NEXT[one])]


def _edits(initial: str, unwanted: bool, truncated: bool, state: int) -> Iterator[tuple[str, int, int]]:
    yield "D", DELETE, state
    if not unwanted:
        more = TRUNCATED if truncated else 0
        if state in KEPT.get(initial, {}):
            yield "K", KEEP + more, KEPT[initial][state]
        yield "R", REROLE + more, NEXT[state]


class Steps:
    """All distinct steps met so far: the situation after a row, and where each state's edit string comes from."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[int, int, Situation]] = {}
        self.moves: list[tuple[tuple[int, str] | None, ...]] = []

    def step(self, situation: Situation, row: tuple[str, bool, bool]) -> tuple[int, int, Situation]:
        """(number of the step, cost common to all states, situation after it)."""
        key = situation, row
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._step(situation, row)
        return found

    def _step(self, situation: Situation, row: tuple[str, bool, bool]) -> tuple[int, int, Situation]:
        costs, ranks = situation
        best: list[tuple[int, int, str, int] | None] = [None] * 4
        for state, cost in enumerate(costs):
            if cost is None:
                continue
            for inserted, paid, middle in _inserted(state):
                for edit, price, end in _edits(*row, middle):
                    candidate = (cost + paid + price, ranks[state], inserted + edit, state)
                    if best[end] is None or candidate < best[end]:
                        best[end] = candidate
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        rank = [0] * 4
        for place_, (_, _, s) in enumerate(order):
            rank[s] = place_
        least = min(b[0] for b in best if b)
        self.moves.append(tuple((b[3], b[2]) if b else None for b in best))
        after = tuple(b[0] - least if b else None for b in best), tuple(rank)
        return len(self.moves) - 1, least, after


class Pointers:
    """Step numbers of one conversation; whole blocks go to files in the shared folder."""

    def __init__(self, folder: str, block: int) -> None:
        self.folder, self.block = folder, block
        self.files: list[str] = []
        self.last = array("I")

    def append(self, step: int) -> None:
        self.last.append(step)
        if len(self.last) == self.block:
            uri = f"{self.folder}/steps-{uuid.uuid4().hex}"
            system, path = place(uri)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(self.last.tobytes())
            self.files.append(uri)
            self.last = array("I")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.last)
        while self.files:
            system, path = place(self.files.pop())
            block = array("I")
            with system.open_input_file(path) as f:
                block.frombytes(f.read())
            system.delete_file(path)
            yield from reversed(block)


class Repair:
    """Edits of one conversation: ``add`` its rows in order, then ask for ``result``."""

    def __init__(self, steps: Steps, folder: str, block: int = SPILL) -> None:
        self.steps, self.pointers = steps, Pointers(folder, block)
        self.situation, self.cost = START, 0
        self.written: list = [hashlib.sha256(), None, None, None]

    def _hashed(self, state: int, edits: str, role: str, text: str):
        """Checksum after these edits; a checksum is shared between states and copied before it grows."""
        done = self.written[state]
        if edits == "D":
            return done
        done = done.copy()
        for edit in edits:
            if edit == "D":
                continue
            end = KEPT[role[:1]][state] if edit == "K" else NEXT[state]
            name, said = (role if edit == "K" else NAMES[end]), ("" if edit == "I" else text)
            done.update(f"{'' if state == NOTHING else chr(10)}{name}:{said}".encode())
            state = end
        return done

    def add(self, role: str, text: str, unwanted: bool, truncated: bool) -> None:
        initial = role[:1] if role[:1] in KEPT else ""
        number, least, self.situation = self.steps.step(self.situation, (initial, unwanted, truncated))
        self.cost += least
        self.pointers.append(number)
        moves = self.steps.moves[number]
        self.written = [self._hashed(m[0], m[1], role, text) if m else None for m in moves]

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired rows)."""
        costs, ranks = self.situation
        ends = [
            (cost + paid, ranks[state], edits, state)
            for state, cost in enumerate(costs)
            if cost is not None
            for edits, paid, end in _inserted(state)
            if end in (NOTHING, ASSISTANT)
        ]
        extra, _, edits, state = min(ends)
        digest = self._hashed(state, edits, "", "").hexdigest() if edits else self.written[state].hexdigest()
        parts = [edits[::-1]]
        for number in self.pointers.backwards():
            state, edits = self.steps.moves[number][state]
            parts.append(edits[::-1])
        return self.cost + extra, "".join(parts)[::-1], digest


def applied(audit: Iterator[str], row: Callable[[], tuple]) -> Iterator[tuple[str, str, tuple | None]]:
    """(edit, role or '' for a kept one, row) of every row that is written; deleted rows are taken and left out."""
    state = NOTHING
    for edit in audit:
        taken = None if edit == "I" else row()
        if edit == "D":
            continue
        end = KEPT[taken[0][:1]][state] if edit == "K" else NEXT[state]
        yield edit, ("" if edit == "K" else NAMES[end]), taken
        state = end

"""Descriptions of a compiled query: index specifications, binary products, nested terms, estimates."""

from __future__ import annotations

import math
import string
from dataclasses import replace

from ..errors import TooManyIndicesError
from .compiler import Compiled, Step


def letters(axes) -> dict[str, str]:
    """A letter for each axis, in order of appearance."""
    names = list(dict.fromkeys(axes))
    if len(names) > len(string.ascii_letters):
        raise TooManyIndicesError(f"{len(names)} axes, {len(string.ascii_letters)} letters")
    return dict(zip(names, string.ascii_lowercase + string.ascii_uppercase))


def spec(step: Step) -> str:
    """Operands' axes and the result's, as in ``abc,b,cd->ad``."""
    of = letters(a for o in step.operands for a in o.axes)
    return ",".join("".join(of[a] for a in o.axes) for o in step.operands) + "->" + "".join(of[a] for a in step.keep if a in of)


def chain(step: Step) -> list[dict]:
    """The product as binary (lambda, mu)-products: shared axes that are kept, and shared axes that are summed."""
    out = []
    have, label = list(step.operands[0].axes), step.operands[0].label
    for i, o in enumerate(step.operands[1:], 1):
        later = {a for x in step.operands[i + 1 :] for a in x.axes} | set(step.keep)
        shared = [a for a in have if a in o.axes]
        lam, mu = [a for a in shared if a in later], [a for a in shared if a not in later]
        have = [a for a in dict.fromkeys([*have, *o.axes]) if a not in mu]
        out.append({"left": label, "right": o.label, "lambda": lam, "mu": mu, "result": list(have)})
        label = f"({label} * {o.label})"
    return out


def summed(step: Step) -> list[str]:
    axes = dict.fromkeys(a for o in step.operands for a in o.axes)
    return [a for a in axes if a not in step.keep]


def term(step: Step) -> str:
    """The product as one nested term."""
    out = step.operands[0].label
    for c in chain(step):
        out = f"product[{len(c['lambda'])},{len(c['mu'])}]({out}, {c['right']})"
    return f"sum[{', '.join(summed(step))}]({out})" if summed(step) else out


def estimate(step: Step, sizes: dict[str, int]) -> dict:
    """Cells of the whole index space and of the result, for axes of these sizes (10 where unknown)."""
    total = result = 1
    for a in dict.fromkeys(a for o in step.operands for a in o.axes):
        total *= sizes.get(a, 10)
    for a in step.keep:
        result *= sizes.get(a, 10)
    return {"operations": total * max(1, len(step.operands) - 1), "result_cells": result}


def split_axis(step: Step, sizes: dict[str, int]) -> str | None:
    """The axis by which the product splits into parts that need no final sum: kept, and in most operands; the larger the better."""
    kept = [a for a in step.keep if any(a in o.axes for o in step.operands)]
    return max(kept, key=lambda a: (sum(a in o.axes for o in step.operands), sizes.get(a, 0)), default=None)


def axis_kinds(step: Step) -> dict[str, str]:
    """Each axis of the result: ``shared`` by several operands, or ``free``."""
    return {a: "shared" if sum(a in o.axes for o in step.operands) > 1 else "free" for a in step.keep}


def replication_factor(step: Step, axis: str) -> int:
    """How many operands each part needs whole when the product is split by ``axis``."""
    return len([o for o in step.operands if o.axes and axis not in o.axes])


def shared_letters(specification: str) -> list[str]:
    """Letters of a specification's result that several operands have."""
    operands, _, result = specification.partition("->")
    return [x for x in result if sum(x in o for o in operands.split(",")) > 1]


def chunk_ranges(length: int, parts: int) -> list[tuple[int, int]]:
    """0..length cut into ``parts`` even ranges, or as many as there are positions."""
    if parts < 1:
        raise ValueError("a range is cut into one part at least")
    parts = min(parts, max(length, 1))
    bounds = [length * k // parts for k in range(parts + 1)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]


def push_projections(step: Step) -> tuple[Step, list[tuple[str, list[str]]]]:
    """The step with axes that one operand alone has, and the result hasn't, summed before the product; and what was summed of which operand."""
    operands, gone = [], []
    for i, o in enumerate(step.operands):
        needed = {a for j, x in enumerate(step.operands) if j != i for a in x.axes} | set(step.keep)
        if alone := [a for a in o.axes if a not in needed]:
            gone.append((o.label, alone))
        operands.append(replace(o, axes=tuple(a for a in o.axes if a in needed)))
    return replace(step, operands=operands), gone


def needs_decomposition(step: Step) -> bool:
    """Whether a step has more axes than a specification has letters."""
    return len({a for o in step.operands for a in o.axes} | set(step.keep)) > len(string.ascii_letters)


def optimize_step(step: Step, sizes: dict[str, int], most_cells: int | None = None) -> dict:
    """Operations and the largest intermediate of the step's chain of binary products, after projections are pushed down.

    ``most_cells``: raise MemoryError where an intermediate has more.
    """
    step, gone = push_projections(step)
    cells = lambda axes: math.prod(sizes.get(a, 10) for a in axes)
    operations, largest, have = 0, cells(step.keep), tuple(step.operands[0].axes)
    for o, c in zip(step.operands[1:], chain(step)):
        operations += cells(dict.fromkeys([*have, *o.axes]))
        have = tuple(c["result"])
        largest = max(largest, cells(have))
    if most_cells is not None and largest > most_cells:
        raise MemoryError(f"an intermediate of {largest} cells exceeds {most_cells}; group by fewer axes")
    return {"operations": operations, "largest": largest, "contractions": len(step.operands) - 1, "pushed": gone}


def spec_cost(specification: str, *shapes: tuple[int, ...], itemsize: int = 8) -> tuple[int, int]:
    """Operations (the whole index space) and bytes moved (operands and result) of a specification over operands of these shapes."""
    operands, arrow, result = specification.partition("->")
    if not arrow:
        return 0, 0
    sizes = {x: n for o, shape in zip(operands.split(","), shapes) for x, n in zip(o, shape)}
    moved = sum(math.prod(shape) for shape in shapes) + math.prod(sizes.get(x, 1) for x in result)
    return math.prod(sizes.values()), moved * itemsize


def describe(compiled: Compiled, sizes: dict[str, int]) -> str:
    lines = [f"groups: {', '.join(compiled.group) or '(one)'}", f"columns: {', '.join(compiled.labels)}"]
    lines += [f"{a} = {' + '.join(t) or '0'}" for a, t in compiled.terms.items()]
    for s in compiled.steps:
        e = estimate(s, sizes)
        lines.append(f"frame {s.title}: {spec(s)}; about {e['operations']} operations, {e['result_cells']} cells; parts by {split_axis(s, sizes) or 'none'}")
        for c in chain(s):
            lines.append(f"  ({len(c['lambda'])},{len(c['mu'])})-product with {c['right']}: keeps {', '.join(c['lambda']) or '-'}, sums {', '.join(c['mu']) or '-'}")
    return "\n".join(lines)

"""Fill-in-the-middle texts: prefix, middle and suffix of a document in another order, with marks between.

A document is cut into units (here lines, each with its line feed). Two borders drawn from the document's id
split the units into prefix, middle and suffix. Two forms write them so that a model that reads from left
to right meets the middle last; other documents stay as they are:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text

Draws are 32-bit numbers from the SHA-256 of ``seed:id``, computed by Spark, so they depend on nothing but
the id. The rest is one ``pyarrow.compute`` pipeline for each Arrow batch, without a loop over rows or units: the texts are
split into list arrays, the lists flattened with the index of their parent, a unit's ordinal is its
place less the place of its parent's first unit, units are filtered by role, put back into lists and
joined. Every row is independent of the others; nothing is shuffled. ``restore`` undoes it from the output
and the form alone: a text that holds a mark stays plain, so the marks of an output are unambiguous.

Nulls, ties, repeats: a null text is an empty one, and an empty text stays plain; a null id draws as an empty
id; repeated rows give equal outputs. Other columns stay as they came, but for those that bear the
names of the new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .base import chunks

# The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, how many are transformed, and how many of those in the form ``spm``.
RATE, SPM_RATE = 100, 50
SEED = 7
#: Characters of the texts handled at a time, about.
STRIP = 8 << 20

_NEW = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The lines of all texts with their line feeds, the text that each belongs to, and its ordinal."""
    parts = pc.split_pattern(texts, "\n")
    flat = pc.list_flatten(parts)
    parent = pc.cast(pc.list_parent_indices(parts), pa.int64())
    ordinal = pc.subtract(_places(len(flat)), pc.take(pc.cast(parts.offsets, pa.int64()), parent))
    size = pc.take(pc.cast(pc.list_value_length(parts), pa.int64()), parent)
    last = pc.equal(pc.add(ordinal, 1), size)
    # All but a text's last part end with a line feed; the last is none if it is empty.
    units = pc.binary_join_element_wise(flat, pc.if_else(last, _large(""), _large("\n")), _large(""))
    real = pc.invert(pc.and_(last, pc.equal(flat, "")))
    return tuple(pc.filter(c, real) for c in (units, parent, ordinal))


def _large(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _places(n: int) -> pa.Array:
    """``0 ... n - 1``."""
    return pc.subtract(pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), n)), 1)


def _counts(parent: pa.Array, rows: int) -> pa.Array:
    """How often each of ``0 ... rows - 1`` stands in a sorted array."""
    found = pc.value_counts(parent)
    at = pc.index_in(_places(rows), value_set=found.field("values")) if len(found) else pa.nulls(rows, pa.int32())
    return pc.fill_null(pc.take(pc.cast(found.field("counts"), pa.int64()), at), 0)


def _joined(units: pa.Array, parent: pa.Array, rows: int) -> pa.Array:
    """The units of each row as one text."""
    ends = pc.cumulative_sum(_counts(parent, rows))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(ends, pa.int32())])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, units), _large(""))


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def transformed(
    texts: pa.Array, h: list[pa.Array], rate: int = RATE, spm_rate: int = SPM_RATE
) -> dict[str, pa.Array]:
    """The new columns of some texts without nulls, from their draws ``h``."""
    rows = len(texts)
    texts = pc.cast(texts, pa.large_string())
    units, parent, ordinal = _units(texts)
    n = _counts(parent, rows)
    x, y = (_modulo(h[i], pc.add(n, 1)) for i in (0, 1))
    a, b = pc.min_element_wise(x, y), pc.max_element_wise(x, y)
    before_a, before_b = (pc.less(ordinal, pc.take(c, parent)) for c in (a, b))
    roles = (before_a, pc.and_not(before_b, before_a), pc.invert(before_b))
    prefix, middle, suffix = (
        _joined(pc.filter(units, role), pc.filter(parent, role), rows) for role in roles
    )
    marked = pc.or_kleene(
        pc.or_kleene(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)),
        pc.match_substring(texts, MIDDLE),
    )
    hundred = pa.repeat(pa.scalar(100, pa.int64()), rows)
    plain = pc.or_kleene(
        pc.or_kleene(marked, pc.equal(texts, "")), pc.greater_equal(_modulo(h[2], hundred), rate)
    )
    spm = pc.less(_modulo(h[3], hundred), spm_rate)
    p, s, m, none = map(_large, (PREFIX, SUFFIX, MIDDLE, ""))
    output = pc.if_else(
        spm,
        pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none),
    )
    number = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, number, pc.cast(pc.utf8_length(prefix), pa.int64())),
        "middle_chars": pc.if_else(plain, number, pc.cast(pc.utf8_length(middle), pa.int64())),
        "output": pc.if_else(plain, texts, output),
    }


def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that some outputs were made of."""
    output = pc.cast(output, pa.large_string())
    plain, spm = pc.equal(form, "plain"), pc.equal(form, "spm")

    def cut(values: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
        """What stands before and after a mark (nothing after, where it is missing)."""
        both = pc.split_pattern(values, mark, max_splits=1)
        after = pc.list_slice(both, 1, 2)
        return pc.list_element(both, 0), pc.binary_join(after, _large(""))

    def opened(values: pa.Array) -> pa.Array:
        return pc.utf8_slice_codeunits(values, len(PREFIX))

    halves, middle = cut(output, MIDDLE)
    first, second = cut(halves, PREFIX)  # spm: mark and suffix, prefix
    other, suffix = cut(opened(halves), SUFFIX)  # psm: prefix, suffix
    prefix = pc.if_else(spm, second, other)
    suffix = pc.if_else(spm, opened(first), suffix)
    whole = pc.binary_join_element_wise(prefix, middle, suffix, _large(""))
    return pc.if_else(plain, output, whole)


def _mapped(df: DataFrame, sources: list[Column], new: dict[str, str], make) -> DataFrame:
    """Replace or add columns that ``make`` computes from the values of some others, in strips."""
    kept = [c for c in df.columns if c not in new]
    slim = df.select(*[F.col(f"`{c}`") for c in kept], *[s.alias(f"_s{i}") for i, s in enumerate(sources)])
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in kept]
    ddl += [f"{name} {kind}" for name, kind in new.items()]
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column(len(kept)))
            for lo, hi in chunks([range(n) for n in lengths.to_pylist()], STRIP):
                part = batch.slice(lo, hi - lo)
                made = make(*part.columns[len(kept) :])
                columns = [pc.cast(made[name], kinds[kind]) for name, kind in new.items()]
                yield pa.RecordBatch.from_arrays(part.columns[: len(kept)] + columns, names=kept + list(new))

    return slim.mapInArrow(run, ", ".join(ddl))


def transform(
    docs: DataFrame,
    seed: int = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows with ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (code points; null if plain) and
    ``output``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return _mapped(
        docs, [text, *draws(id_col, seed)], _NEW,
        lambda texts, *h: transformed(texts, list(h), rate, spm_rate),
    )


def restore(docs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The rows with ``restored``, the text that the output was made of. A null output restores as an
    empty text, a null form as plain."""
    sources = [F.coalesce(F.col(output_col), F.lit("")), F.coalesce(F.col(form_col), F.lit("plain"))]
    return _mapped(
        docs, sources, {"restored": "string"}, lambda output, form: {"restored": restored(output, form)}
    )

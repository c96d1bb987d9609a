"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model holds a white-space marker after another character, so
no merge crosses from a character into the marker that follows it, and a text
can be cut there.  Each block of texts is cut into marked words (a run of
markers and the word behind it), each distinct marked word is segmented once by
the library, and the ids are joined back by position.  A model with pieces that
cross a marker, or one that changes white space or composes characters, is encoded
by whole texts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobweave.llm.blocks import ChunkTable, Words, filled, flattened, gaps, joined_by_row, text_blocks

MARK = "▁"
_MARKED = re.compile(r" +[^ ]*")
#: Strings that a model must carry through unchanged for texts to be cut at markers.
_PLAIN = ("a  b", " a", "a ", "ﬁ", "é", " x", "a\nb", "a\tb")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.vocab_size()))
    plain = all(model.decode(model.encode(x)) == x for x in _PLAIN)
    return model, plain and not crossing


@lru_cache(maxsize=2)
def _table(path: str) -> ChunkTable:
    model, _ = _model(path)

    def segment(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [flattened(model.encode(words[a : a + 20_000], num_threads=1)) for a in range(0, len(words), 20_000)]
        return np.concatenate([flat for flat, _ in got]), np.concatenate([lengths for _, lengths in got])

    return ChunkTable(segment)


def encode_texts(texts: pa.Array, path: str) -> pa.ListArray:
    """Ids of each text, without begin or end ids."""
    model, separable = _model(path)
    texts = filled(texts)
    if not separable:
        return pa.array(model.encode(texts.to_pylist(), num_threads=1), pa.list_(pa.int32()))
    if len(texts) == 1 and (cuts := gaps(texts[0].as_py())):
        # A text longer than a block goes in parts; the space at a cut is the marker of the word behind it.
        text, ends = texts[0].as_py(), [-1, *cuts]
        parts = [encode_texts(pa.array([text[a + 1 : b]]), path).flatten() for a, b in itertools.pairwise([*ends, len(text)])]
        flat = pa.concat_arrays(parts)
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
    words = Words(texts)
    odd_value = np.fromiter((not v or MARK in v for v in words.values), bool, len(words.values))
    odd_rows = np.flatnonzero(words.rows_with(odd_value)).tolist()
    table = _table(path)
    # Texts with runs of spaces, or spaces at an end, are cut one by one; each chunk keeps its whole run.
    other = {}
    for row in odd_rows:
        text = texts[row].as_py().replace(MARK, " ")
        chunks = [c[1:] for c in _MARKED.findall(" " + text)] if text else []
        other[row] = np.asarray([i for c in chunks for i in (model.encode(c) if c else model.piece_to_id([MARK]))], np.int32)
    return joined_by_row(table, table.rows(words.values)[words.codes], words.bounds, other)


#: Ids that are decoded at a time, about.
DECODED = 1 << 18


def _decoded(model, opens: np.ndarray, ids: np.ndarray) -> str:
    """What the library decodes from the ids, in parts where they are many: a part begins at a
    piece with one marker, which the library drops at the start of a text."""
    cuts = [0]
    while len(ids) - cuts[-1] > DECODED and len(at := np.flatnonzero(opens[ids[cuts[-1] + DECODED : cuts[-1] + 2 * DECODED]])):
        cuts.append(cuts[-1] + DECODED + int(at[0]))
    return " ".join(model.decode(ids[a:b].tolist()) for a, b in itertools.pairwise([*cuts, len(ids)]))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and ids (array of int), exactly as the library encodes the whole text.

    Null and empty texts have no ids; texts of any length are encoded whole;
    repeated rows stay; an empty table gives no rows; other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column(0), encode_texts(block.column(1), model_path)], ["id", "ids"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with the text that the library decodes from ``ids_col`` as column decoded (which is replaced if it exists).

    Null ids are decoded like an empty list, to an empty text; repeated rows are decoded each;
    an empty table gives no rows; other columns are passed through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(model_path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        opens = np.fromiter((len(p) > 1 and p[0] == MARK != p[1] for p in pieces), bool, len(pieces))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = part.column(part.schema.get_field_index(ids_col))
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends, flat = np.concatenate([[0], np.cumsum(sizes)]), pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
                if len(flat) <= DECODED:
                    texts = model.decode([flat[x:y].tolist() for x, y in itertools.pairwise(ends)], num_threads=1) if part.num_rows else []
                else:
                    texts = [_decoded(model, opens, flat[x:y]) for x, y in itertools.pairwise(ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    rows = encoded.drop("decoded")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))

"""Mode scores by block rows: one shuffle, in which the last line of each block row also goes to the row below it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for the line above and the column to the left outside the image, and the mean without either.
ABOVE, LEFT, MEAN = 127, 129, 128
SCORES = "image_id long, plane string, mby long, mbx long, mode int, sad long"


def block_rows(samples: DataFrame) -> DataFrame:
    """Rows (image_id, plane, size, mby, packed) of samples (image_id, plane, size, y, x, s): a block row's samples and the line
    above it, each as one number of line (0 is the halo), place and level."""
    own = F.struct(F.floor(F.col("y") / F.col("size")).cast("long").alias("mby"), (F.col("y") % F.col("size") + 1).cast("long").alias("line"))
    below = F.struct((own["mby"] + 1).alias("mby"), F.lit(0).cast("long").alias("line"))
    sent = samples.withColumn("to", F.explode(F.when(own["line"] == F.col("size"), F.array(own, below)).otherwise(F.array(own))))
    number = F.shiftleft(F.shiftleft(F.col("to.line"), 16) + F.col("x").cast("long"), 8) + F.col("s").cast("long")
    return sent.groupBy("image_id", "plane", "size", F.col("to.mby").alias("mby")).agg(F.collect_list(number).alias("packed"))


def row_scores(packed: np.ndarray, size: int, mby: int) -> np.ndarray:
    """Absolute errors (block, mode) of a block row: the mean of the edges, vertical, horizontal, true motion."""
    line, x, s = packed >> 24, packed >> 8 & 0xFFFF, packed & 0xFF
    width = -(-(int(x[line > 0].max()) + 1) // size) * size
    grid = np.full((size + 1, width), -1, np.int64)
    inside = x < width
    grid[line[inside], x[inside]] = s[inside]
    blocks = grid[1:].reshape(size, -1, size).transpose(1, 0, 2)
    n = len(blocks)
    above = grid[0].reshape(n, size) if mby else np.full((n, size), ABOVE)
    left = np.concatenate([np.full((1, size), LEFT), blocks[:-1, :, -1]])
    corner = np.append(LEFT, grid[0][size - 1 : -1 : size])[:n] if mby else np.full(n, ABOVE)
    sides = np.concatenate([above if mby else np.full((n, size), -1), np.where(np.arange(n)[:, None] > 0, left, -1)], 1)
    known, edges = (sides >= 0).sum(1), np.maximum(sides, 0).sum(1)
    mean = np.where(known > 0, (2 * edges + known) // np.maximum(2 * known, 1), MEAN)
    motion = np.clip(left[:, :, None] + above[:, None, :] - corner[:, None, None], 0, 255)
    guesses = (mean[:, None, None], above[:, None, :], left[:, :, None], motion)
    there = blocks >= 0
    return np.stack([(np.abs(blocks - g) * there).sum((1, 2)) for g in guesses], 1)


def halo_scores(samples: DataFrame) -> DataFrame:
    """Rows (image_id, plane, mby, mbx, mode, sad), as ``blocks.mode_scores``, of all planes in one shuffle.

    samples: (image_id, plane, size, y, x, s), levels 0 to 255, size the side of a plane's blocks, x below 65,536. Of blocks that
    are not whole, the samples that are there count; padded planes have none. A group is a block row, at most 17 lines of an image's width, whatever its height.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for image, plane, size, mby, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                numbers = packed.values.to_numpy(zero_copy_only=False)
                if not (numbers >> 24 > 0).any():
                    continue  # a halo below the last block row
                sad = row_scores(numbers, size, mby)
                n = len(sad)
                for column, values in zip(out, ([image] * 4 * n, [plane] * 4 * n, [mby] * 4 * n, np.repeat(np.arange(n), 4).tolist(), [0, 1, 2, 3] * n, sad.ravel().tolist())):
                    column.extend(values)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["image_id", "plane", "mby", "mbx", "mode", "sad"])

    rows = block_rows(samples).select(F.col("image_id").cast("long"), "plane", F.col("size").cast("int"), "mby", "packed")
    return rows.mapInArrow(run, SCORES)

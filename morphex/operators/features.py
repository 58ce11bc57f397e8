"""Embeddings of images by a stored network: evaluation transforms, a session per task, class or projector token, best patch tokens.

Images are rows (ref, height, width, pixels): ``pixels`` holds height x width x 3 bytes, red, green and blue. Decoding is left to the
source. A network is an ONNX file that every executor can read; nothing is collected, and rows without usable pixels come out with
a reason instead of a vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distances import scaled_components

#: Mean and standard deviation of the channels that networks are trained with, and the fill of a failed edge estimate.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
FALLBACK_FILL = (124, 116, 104)
TRANSFORMS = ("center-crop", "whole-specimen-pad")
#: Images that go through the network at once.
BATCH_IMAGES = 32


def cubic_weights(size: int, wanted: int) -> np.ndarray:
    """(wanted, size) weights of a cubic resampling of one side (a = -1/2), widened when the side shrinks; each row sums to one."""
    step = size / wanted
    wide = max(1.0, step)
    centre = (np.arange(wanted) + 0.5) * step
    t = np.abs((np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide)
    w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cubic resampling to height x width, rounded to bytes after each side."""
    if image.shape[:2] == (height, width):
        return image
    across = np.clip(np.rint(np.einsum("wx,hxc->hwc", cubic_weights(image.shape[1], width), image.astype(float))), 0, 255)
    return np.clip(np.rint(np.einsum("hy,ywc->hwc", cubic_weights(image.shape[0], height), across)), 0, 255).astype(np.uint8)


def background(image: np.ndarray) -> tuple[int, int, int]:
    """Median colour of the four outer edges."""
    if image.shape[0] < 2 or image.shape[1] < 2:
        return FALLBACK_FILL
    edges = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
    return tuple(int(x) for x in np.median(edges, axis=0))


def squared(image: np.ndarray) -> np.ndarray:
    """The image in the middle of a square of its background colour."""
    h, w = image.shape[:2]
    side = max(h, w)
    out = np.empty((side, side, 3), np.uint8)
    out[:] = background(image)
    top, left = (side - h) // 2, (side - w) // 2
    out[top : top + h, left : left + w] = image
    return out


def centre_cropped(image: np.ndarray, size: int) -> np.ndarray:
    """The shorter side resized to ``size``, then the middle square."""
    h, w = image.shape[:2]
    short = min(h, w)
    image = resized(image, max(size, int(size * h / short)), max(size, int(size * w / short)))
    top, left = round((image.shape[0] - size) / 2), round((image.shape[1] - size) / 2)
    return image[top : top + size, left : left + size]


def prepared(image: np.ndarray, size: int, transform: str = "center-crop") -> np.ndarray:
    """(3, size, size) float32 input of a network."""
    if transform not in TRANSFORMS:
        raise ValueError(f"transform must be one of {TRANSFORMS}")
    image = centre_cropped(image, size) if transform == "center-crop" else resized(squared(image), size, size)
    return ((image / 255 - CHANNEL_MEAN) / CHANNEL_STD).transpose(2, 0, 1).astype(np.float32)


def open_network(path: str):
    """(session, input name, input size): the size is that of the network where it is fixed, else None."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # tasks are the parallelism
    session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    first = session.get_inputs()[0]
    side = first.shape[-1]
    return session, first.name, side if isinstance(side, int) else None


def _vectors(out: np.ndarray, token: str, k: int, prefix: int) -> np.ndarray:
    """Rows of features from a network's output: (n, d), (n, d, 1, 1) or tokens (n, t, d)."""
    if token == "projector" or out.ndim != 3:
        return out.reshape(len(out), -1)
    if token == "cls":
        return out[:, 0]
    patches = out[:, prefix:]
    length = np.sqrt((patches.astype(float) ** 2).sum(axis=2))
    best = np.argsort(-length, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(patches, best[:, :, None], axis=1).reshape(len(out), -1)


def extract_embeddings(images: DataFrame, network: str, size: int = 224, transform: str = "center-crop", token: str = "cls", k: int = 10, prefix: int = 1) -> DataFrame:
    """(ref, v, reason) of images (ref, height, width, pixels).

    ``token``: ``cls`` (first token), ``projector`` (the output as it is) or ``patch-topk`` (the ``k`` tokens of greatest norm after ``prefix``
    special ones, end to end, greatest first; ties to the earlier). The network is opened once per task and run on BATCH_IMAGES
    images at a time; a size that the file fixes wins over ``size``. reason is null, ``missing_pixels`` (null or a
    length that isn't height x width x 3) or ``not_finite``; v is null where there is a reason.
    """
    if token not in ("cls", "projector", "patch-topk"):
        raise ValueError(f"unknown token {token}")
    if transform not in TRANSFORMS:
        raise ValueError(f"transform must be one of {TRANSFORMS}")

    def run(batches):
        session, name, fixed = None, None, None
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_IMAGES):
                part = batch.slice(a, BATCH_IMAGES)
                if session is None:
                    session, name, fixed = open_network(network)
                inputs, reasons = [], []
                for h, w, data in zip(*(part.column(c).to_pylist() for c in ("height", "width", "pixels"))):
                    fits = data is not None and h and w and len(data) == h * w * 3
                    reasons.append(None if fits else "missing_pixels")
                    if fits:
                        inputs.append(prepared(np.frombuffer(data, np.uint8).reshape(h, w, 3), fixed or size, transform))
                found = iter(_vectors(session.run(None, {name: np.stack(inputs)})[0], token, k, prefix) if inputs else ())
                vectors = []
                for i, why in enumerate(reasons):
                    v = next(found) if why is None else None
                    if v is not None and not np.isfinite(v).all():
                        reasons[i], v = "not_finite", None
                    vectors.append(v)
                yield pa.RecordBatch.from_arrays([part.column("ref"), pa.array(vectors, pa.list_(pa.float32())), pa.array(reasons, pa.string())], names=["ref", "v", "reason"])

    return images.select("ref", "height", "width", "pixels").mapInArrow(run, "ref string, v array<float>, reason string")


def patch_features(tokens: DataFrame, k: int, prefix: int = 1) -> DataFrame:
    """(id, v) of (id, tokens): each image's ``k`` tokens of greatest norm end to end, then scaled and projected on principal components over all images."""
    from ..functions.scalars import top_tokens

    chosen = tokens.select("id", top_tokens(F.col("tokens"), k, prefix).alias("v")).where(F.size("v") > 0)
    return scaled_components(chosen, k)

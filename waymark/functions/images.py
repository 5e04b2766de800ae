"""Grey-level kernels in numpy, for use inside tasks on decoded frames."""

from __future__ import annotations

import numpy as np


def invert(image: np.ndarray) -> np.ndarray:
    return 255 - image


def gamma(image: np.ndarray, value: float) -> np.ndarray:
    """Output is input ** (1 / value)."""
    curve = (np.arange(256) / 255.0) ** (1.0 / max(value, 1e-6)) * 255
    return curve.astype(np.uint8)[image]


#: Tone curves on [0, 1]; the detector's and the tuner's log curves differ.
CURVES = {
    "none": lambda f: f,
    "sqrt": np.sqrt,
    "log": lambda f: np.log1p(f * (np.e - 1.0)),
    "tuning_log": lambda f: np.log1p(9.0 * f) / np.log1p(9.0),
}


def tone(image: np.ndarray, curve: str) -> np.ndarray:
    return np.clip(CURVES.get(curve, CURVES["none"])(image.astype(np.float32) / 255.0) * 255.0, 0, 255).astype(np.uint8)


def contrast(image: np.ndarray, factor: float) -> np.ndarray:
    """Spread around the rounded mean grey level."""
    mean = int(image.mean() + 0.5) if image.size else 0
    return np.clip(mean + factor * (image.astype(np.float32) - mean), 0, 255).astype(np.uint8)


def blur(image: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Gaussian blur with mirrored borders, as floats."""
    k = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        out = np.apply_along_axis(np.convolve, axis, padded, k, "valid")
    return out


def sharpen(image: np.ndarray, size: int = 5, sigma: float = 1.0, amount: float = 1.0) -> np.ndarray:
    return np.clip(np.rint((1 + amount) * image - amount * np.rint(blur(image, size, sigma))), 0, 255).astype(np.uint8)


def enhance(image: np.ndarray, params: dict) -> np.ndarray:
    """The detector's chain of the stages that need no image library; ``no_enhance`` skips all."""
    if params.get("no_enhance"):
        return image
    if params.get("invert"):
        image = invert(image)
    image = tone(image, params.get("tone_map", "none"))
    if params.get("use_gamma"):
        image = gamma(image, float(params.get("gamma", 1.0)))
    if params.get("unsharp_amount"):
        image = sharpen(image, int(params.get("kernel_size", 5)), float(params.get("sigma", 1.0)), float(params["unsharp_amount"]))
    return contrast(image, float(params["contrast"])) if params.get("contrast") else image


def strip(image: np.ndarray, crops: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Crops (x1, y1, x2, y2) side by side from the left, black below shorter ones."""
    height = max((y2 - y1 for _, y1, _, y2 in crops), default=0)
    out = np.zeros((height, sum(x2 - x1 for x1, _, x2, _ in crops)), image.dtype)
    x = 0
    for x1, y1, x2, y2 in crops:
        out[: y2 - y1, x : x + x2 - x1] = image[y1:y2, x1:x2]
        x += x2 - x1
    return out

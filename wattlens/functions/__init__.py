from . import arrays, binning, codes, maths, text, times  # noqa: F401

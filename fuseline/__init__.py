"""fuseline: byte-level vocabularies and simplex geometry as Spark DataFrame jobs."""

from .functions.simplex import DIM
from .functions.text import Normalizer
from .plans.model import Model, Point, ReservedIds
from .plans.train import Result, Step, train

__version__ = "0.1.0"
__all__ = ["DIM", "Model", "Normalizer", "Point", "ReservedIds", "Result", "Step", "train"]

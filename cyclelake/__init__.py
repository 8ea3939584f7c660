"""cyclelake: manufacturing-cycle analytics as ordinary PySpark DataFrame functions."""

__version__ = "0.1.0"

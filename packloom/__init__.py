"""packloom: course-package and text analytics written for Spark."""

__version__ = "0.1.0"

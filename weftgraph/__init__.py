"""Graph analytics over entity-annotated literature, as DataFrame transformations."""

__version__ = "0.1.0"

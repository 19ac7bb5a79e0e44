"""vertexloom: labelled-graph analytics expressed as DataFrame plans."""

__version__ = "0.1.0"

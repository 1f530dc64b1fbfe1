"""Training-data operators: ten dealt operators over the text tables and the pipeline's stages.

Nothing else in the library imports this subpackage.
"""

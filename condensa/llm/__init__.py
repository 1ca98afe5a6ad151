"""Operations for large training-data pipelines.

Nothing outside this package imports it; delete the folder (and
``corpus_pipeline.py``) and the rest of the library keeps working.
"""

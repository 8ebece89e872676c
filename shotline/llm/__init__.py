"""Operations of a training-data pipeline over text tables.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""

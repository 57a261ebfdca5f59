"""Training-data operators: quality rules, deduplication, mixing, packing, extraction and scoring.

Nothing outside this subpackage imports it.  Every operator reads only the columns it names, so extra
or clashing columns are ignored; null texts count as empty unless an operator says otherwise.
"""

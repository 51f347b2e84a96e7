"""Table operators, one module per family; every one takes and returns DataFrames."""

"""Documents that declare what is computed, and their translation into DataFrames."""

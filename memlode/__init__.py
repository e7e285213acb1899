"""memlode: retrieval, curation and corpus preparation over DataFrames."""

"""Training-data operators: packing, binary output, cleaning, extraction, near-dedup, language ID, mixing and scans."""

"""Jobs for training data: search, duplicates, tokens, filters, packing and scans."""

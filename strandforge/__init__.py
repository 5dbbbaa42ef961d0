"""A PySpark-native engine for sequencing-archive tables: alignments, spots and references as
DataFrames, filtered, mated, formatted and written as SAM, BAM, FASTA or FASTQ."""

"""quillspark: constraint data, candidate texts and text metrics as Spark DataFrame jobs."""

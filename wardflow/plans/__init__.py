"""Jobs and named result sets composed from operators."""

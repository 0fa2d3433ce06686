"""Operators: one public function per operation, DataFrame in, DataFrame out."""

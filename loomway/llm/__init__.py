"""Operators over text corpora: encoding, mixing and subject areas."""

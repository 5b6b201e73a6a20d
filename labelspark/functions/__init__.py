"""Column functions: text cleaning, id normalisation, prediction and loss math."""

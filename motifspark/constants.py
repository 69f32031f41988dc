"""Alphabets, residue groups, matrices and chemical scales.

Every literal below is a published or configured constant that results depend on.
"""

# Residue alphabets (B, J, O are phosphorylated S, T, Y).
RESIDUES = "DERHKSTNQCGPAVILMFYW"
PHOSPHO = "BJO"
PLAIN_OF_PHOSPHO = "STY"
RESIDUES_PHOSPHO = RESIDUES + PHOSPHO
MOTIF_LENGTH = 15

# Side-chain classes. W sits in two; the later class is the one it is encoded as.
CHEMICAL_CLASSES = {
    "Acidic": "DE",
    "Basic": "KR",
    "ST": "STBJ",
    "Phenyl": "FYWO",
    "Aliphatic": "AVILM",
    "Polar": "NQHC",
    "Proline": "P",
    "Glycine": "G",
    "Indole": "W",
}

# Residues that stand in for a residue with too few observations.
EQUIVALENTS = {
    "D": "DE", "E": "DE", "R": "RK", "K": "RK", "H": "HNQRK",
    "S": "STBJ", "T": "STBJ", "B": "STBJ", "J": "STBJ",
    "F": "FYO", "Y": "FYO", "O": "FYO", "W": "WYF",
    "A": "AVG", "V": "AVIL", "I": "VILM", "L": "VILM", "M": "ILM",
    "N": "NQHC", "Q": "NQHC", "C": "NQHC", "P": "P", "G": "GA",
}

# Default model settings. Positions are 1-based.
MIN_MEMBERS = 24
MIN_AA_ENTRIES = 5
FORBIDDEN_THRESHOLD = 8
FORCED_REQUIRED = {8: "FY", 10: "DESTBJ"}
SUPPRESSED_FORBIDDEN = (1, 2, 3, 4, 5, 12, 14, 15)
POSITION_WEIGHTS = (0.5, 0.5, 0.5, 0.5, 0.5, 1, 2, 3, 3, 3, 3, 0, 1, 0, 0)
POSITION_RULES = {8: "FY", 10: "DEST", 11: "AVILMFYWSTHNQCGP"}
LEADING_PAD = "G" * 6
TRAILING_PAD = "G" * 2
TRIM_BEGIN, TRIM_END = 6, 2

# The classical core matrix, motif positions 7 to 13.
CLASSICAL_MATRIX = """
aa #7 #8 #9 #10 #11 #12 #13
A 1 4 1 2 0 0 1
C 1 4 1 2 0 0 1
D 0 4 1 0 4 0 0
E 0 4 1 0 4 0 0
F 1 0 0 2 2 0 1
G 1 4 1 2 1 0 1
H 1 4 0.5 2 2 0 1.5
I 1 4 1 2 2 0 1
K 1.5 4 1 2 2 0 1.5
L 1 4 1 2 2 0 1
M 1 4 1 2 2 0 1
N 1 4 1 2 2 0 1
P 1 4 1 2 2 0 1
Q 1 4 1 2 2 0 1
R 2 4 1 2 3 0 1.5
S 0.5 4 1 0.5 0.5 0 0.5
T 0.5 4 1 0.5 0.5 0 0.5
V 1 4 1 2 2 0 1
W 1 2 0.5 2 2 0 1
Y 1 0.5 0 2 2 0 1
"""

# Charge of the acidic tract in front of the core, and the points its sum is worth.
TRACT_CHARGES = {"D": -1.0, "E": -1.0, "S": -0.5, "T": -0.5, "R": 1.0, "K": 1.0}
TRACT_POINTS = ((-4.0, 0.0), (-3.0, 0.5), (-2.0, 1.0))
TRACT_POINTS_ELSE = 1.5

# BLOSUM62, published lower triangle. Other tables can be passed instead.
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
X  0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1
"""

# Measured residue scales (Kyte-Doolittle hydropathy, Huang-Nau flexibility).
HYDROPATHY = {
    "I": 4.5, "V": 4.2, "L": 3.8, "F": 2.8, "C": 2.5, "M": 1.9, "A": 1.8, "G": -0.4, "T": -0.7, "S": -0.8,
    "W": -0.9, "Y": -1.3, "P": -1.6, "H": -3.2, "E": -3.5, "Q": -3.5, "D": -3.5, "N": -3.5, "K": -3.9,
    "R": -4.5, "B": -4.0, "J": -3.5, "O": -2.0,
}
FLEXIBILITY = {
    "G": 39.0, "S": 25.0, "D": 19.0, "N": 20.0, "A": 18.0, "T": 11.0, "L": 10.0, "F": 7.6, "E": 7.4, "Q": 7.2,
    "H": 4.8, "R": 4.6, "K": 2.8, "V": 3.0, "I": 2.3, "P": 0.1, "C": 20.0, "M": 4.0, "Y": 6.0, "W": 2.0,
    "B": 8.0, "J": 5.0, "O": 2.0,
}

# Side-chain scales that are zero for every residue not listed.
CHARGE = {"D": -1.0, "E": -1.0, "C": -0.0968, "K": 1.0, "R": 1.0, "H": 0.0418, "B": -1.8882, "J": -1.8882,
          "O": -1.8882}
STACKING = {"F": 1.0, "H": 0.25, "W": 0.5, "Y": 0.75}
PHOSPHATES = {"B": 1, "J": 1, "O": 1}
BRANCHES = {"V": 1, "I": 1, "L": 1, "T": 1, "J": 1}
NITROGEN_RINGS = {"H": 1, "W": 1}
AROMATIC_RINGS = {"F": 1, "Y": 1, "W": 1, "O": 1}

# Spacer length, alkyl carbons and longest chain of each side chain.
SPACER = dict(A=1, C=1, D=1, E=2, F=1, H=1, I=3, K=4, L=3, M=2, N=1, P=3, Q=2, R=3, S=1, T=2, V=2, W=1, Y=1, B=1,
              J=2, O=1)
ALKYL = dict(A=1, V=3, I=4, L=4, M=3, F=1, Y=1, W=1, S=1, T=2, N=1, Q=2, C=1, P=3, R=3, H=1, K=4, D=1, E=2, B=1,
             J=2, O=1)
LONGEST = dict(A=1, V=2, I=3, L=3, M=4, F=5, Y=6, W=7, S=2, T=2, N=3, Q=4, C=2, P=3, R=6, H=4, K=5, D=2, E=3, B=4,
               J=4, O=8)

# Side-chain formulas and atomic masses; weights and atom counts follow from them.
SIDE_CHAIN_FORMULA = dict(
    A="C1H3", C="C1H3S1", D="C2H3O2", E="C3H5O2", F="C7H7", G="H1", H="C4H5N2", I="C4H9", K="C4H10N1", L="C4H9",
    M="C3H7S1", N="C2H4N1O1", P="C3H6", Q="C3H6N1O1", R="C4H10N3", S="C1H3O1", T="C2H5O1", V="C3H7", W="C9H8N1",
    Y="C7H7O1", B="C1H4O4P1", J="C2H6O4P1", O="C7H8O4P1",
)
ATOMIC_MASS = {"C": 12.0, "H": 1.007825, "N": 14.003074, "O": 15.994915, "P": 30.973762, "S": 31.972071}

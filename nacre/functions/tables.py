"""Fixed values of the chemistry, as plain literals, and the few lookups made of them.

They are parameters fitted or compiled elsewhere; results agree with other tools only with these very numbers. Everything
below FIXED VALUES is data; functions of it follow at the end."""

from __future__ import annotations

# --- FIXED VALUES --------------------------------------------------------------------------------------------------

AMINO_ACIDS = [
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "MSE",
    "SEC", "PYL", "CCS", "CSO", "CSD", "CME", "OCS", "KCX", "LLP", "MLY", "M3L", "PTR", "SEP", "TPO", "HYP", "PCA", "CGU", "CSX", "SMC", "NEP", "MLZ",
    "FME", "CRO", "CR2", "CR8", "NH2",
]
STANDARD_AMINO_ACIDS = [
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "MSE",
    "SEC", "PYL",
]
NUCLEIC_ACIDS = [
    "A", "G", "C", "T", "U", "DA", "DG", "DC", "DT", "DU", "RA", "RG", "RC", "RT", "RU", "5MC", "PSU", "7MG", "2MG", "1MA", "H2U", "OMC", "5MU", "M2G",
    "5HC", "YG", "6MA", "OMG", "4SU",
]
STANDARD_NUCLEIC_ACIDS = ["A", "G", "C", "T", "U", "DA", "DG", "DC", "DT", "DU", "RA", "RG", "RC", "RT", "RU"]
WATERS = ["HOH", "WAT", "OH2", "DOD", "TP3", "TIP", "SOL"]

ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLU": "E", "GLN": "Q", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K",
    "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U", "PYL": "O", "DA": "A",
    "DG": "G", "DC": "C", "DT": "T", "DU": "U", "A": "A", "G": "G", "C": "C", "U": "U",
}
BACKBONE_ATOMS = ["N", "CA", "C", "O", "OXT"]

# Radii for solvent-accessible surfaces, in angstroms; other elements take the contact radii.
SURFACE_RADII = {
    "C": 1.87, "N": 1.65, "O": 1.4, "S": 1.85, "P": 1.9, "SE": 1.9, "MG": 1.39, "ZN": 1.39, "CA": 1.2, "NA": 1.75, "K": 2.75, "CL": 1.75, "BR": 1.85,
    "I": 1.98, "MN": 1.73, "FE": 1.9, "CO": 1.9, "NI": 1.63, "CU": 1.75, "CD": 1.58, "HG": 1.9, "GD": 2.75,
}
SP2_CARBON_RADIUS = 1.76
SP2_CARBONS = [
    "ASP:CG", "GLU:CD", "ASN:CG", "GLN:CD", "ARG:CZ", "PHE:CG", "PHE:CD1", "PHE:CD2", "PHE:CE1", "PHE:CE2", "PHE:CZ", "TYR:CG", "TYR:CD1", "TYR:CD2",
    "TYR:CE1", "TYR:CE2", "TYR:CZ", "TRP:CG", "TRP:CD1", "TRP:CD2", "TRP:CE2", "TRP:CE3", "TRP:CZ2", "TRP:CZ3", "TRP:CH2", "HIS:CG", "HIS:CD2", "HIS:CE1",
]
SURFACE_NUCLEOTIDES = ["A", "G", "C", "U", "DA", "DG", "DC", "DT", "DU", "RA", "RG", "RC", "RT", "RU"]

# Radii for the classes of contacts, in the order in which an unlisted element's first letter is looked for.
CONTACT_RADII = {
    "H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8, "F": 1.47, "CL": 1.75, "BR": 1.85, "I": 1.98, "FE": 1.8, "ZN": 1.8, "MG": 1.7,
    "CA": 1.7, "CU": 1.8, "NA": 1.8, "PB": 1.8, "CO": 1.8, "NI": 1.8, "MO": 1.8, "W": 1.8,
}
OTHER_RADIUS = 1.70

# Solvation energy by class of atom, kcal/mol per square angstrom.
SOLVATION = {
    "C_CA": -0.01507, "C_bb": -0.01389, "C_ali": -0.01597, "C_aro": -0.01685, "C_sp2_polar": -0.01852, "N_bb": 0.01148, "N_amide": 0.01107,
    "N_arg": 0.02281, "N_lys": 0.0306, "N_his": 0.02218, "N_trp": 0.01012, "O_bb": 0.01033, "O_amide": 0.01633, "O_carbox": 0.01399, "O_hyd": 0.01094,
    "S_met": -0.03919, "S_cys": -0.03928, "NA_C_sugar": 0.03201, "NA_C_base": 0.03358, "NA_N_base": 0.01071, "NA_O_base": -0.05815,
    "NA_O_sugar": -0.04136, "NA_OP": -0.05212, "NA_P": 0.0, "C": -0.00135, "N": 0.02071, "N+": 0.02033, "O": 0.00315, "O-": 0.0089, "OP": -0.03866,
    "OI": -0.08546, "S": -0.03986, "P": 0.0, "HAL": -0.0157, "MET": -0.08818, "ZN": -0.33657, "X": 0.0,
}
# What single atoms add to their class.
SOLVATION_BY_ATOM = {
    "A:N6": 0.00275, "ALA:C": 5e-05, "ALA:CA": -0.00044, "ALA:CB": 0.00029, "ALA:N": -0.00019, "ALA:O": 0.00067, "ARG:CA": -0.00466, "ARG:CB": 0.00159,
    "ARG:CD": 0.00066, "ARG:CG": 0.00399, "ARG:CZ": -0.01146, "ARG:N": -0.00316, "ARG:NE": 0.00012, "ARG:NH1": 0.00268, "ARG:NH2": -0.00279,
    "ARG:O": 0.0009, "ASN:CA": -0.00023, "ASN:CB": 0.00028, "ASN:CG": 0.00368, "ASN:N": -2e-05, "ASN:ND2": 3e-05, "ASN:O": 0.0009, "ASN:OD1": -0.00012,
    "ASP:CA": -0.00012, "ASP:CB": 0.00046, "ASP:CG": 0.00245, "ASP:N": -0.00053, "ASP:O": 0.00073, "ASP:OD1": 0.00028, "ASP:OD2": -0.00043,
    "CYS:CA": -0.00113, "CYS:CB": -0.00025, "CYS:O": 0.00023, "CYS:SG": 0.0, "DA:C2": -0.00203, "DA:N1": -0.0035, "DA:N6": 0.00515, "DA:OP1": 0.00416,
    "DA:OP2": 0.00073, "DC:N3": -0.00112, "DC:N4": 0.0071, "DC:O2": -0.0011, "DC:OP1": 0.00474, "DC:OP2": 0.00224, "DG:N1": -0.00707, "DG:N2": 0.00859,
    "DG:O6": -0.00155, "DG:OP1": 0.00461, "DG:OP2": -0.0013, "DT:C7": -0.03001, "DT:N3": -0.00204, "DT:O2": 0.00128, "DT:O4": -0.00231, "DT:OP1": 0.00392,
    "DT:OP2": -0.00228, "GLN:CA": 0.00017, "GLN:CB": 0.00031, "GLN:CD": 0.00349, "GLN:CG": 0.00164, "GLN:NE2": -3e-05, "GLN:O": 0.00069,
    "GLN:OE1": 0.00012, "GLU:CA": -0.00094, "GLU:CB": 0.00014, "GLU:CD": 0.00184, "GLU:CG": 0.00181, "GLU:N": -0.00053, "GLU:O": 0.00073,
    "GLU:OE1": 0.00042, "GLU:OE2": -0.00026, "GLY:C": 0.00037, "GLY:CA": -0.00045, "GLY:N": -0.00065, "GLY:O": 0.00053, "HIS:CA": 0.01211,
    "HIS:CB": -0.0027, "HIS:CD2": 0.00145, "HIS:CE1": 0.00085, "HIS:CG": -0.0149, "HIS:ND1": 0.01473, "HIS:NE2": -0.01473, "HIS:O": 0.00257,
    "ILE:CA": -0.00263, "ILE:CB": 0.00044, "ILE:CD1": 0.00051, "ILE:CG1": 0.00063, "ILE:CG2": 0.00058, "ILE:N": 3e-05, "ILE:O": 0.00093,
    "LEU:C": -0.00206, "LEU:CA": -0.00017, "LEU:CB": 0.00042, "LEU:CD1": 0.00038, "LEU:CD2": 0.00036, "LEU:CG": 0.00016, "LEU:N": -0.0009,
    "LEU:O": 0.0005, "LYS:CA": 0.00033, "LYS:CB": -0.00012, "LYS:CD": -0.00042, "LYS:CE": -0.00192, "LYS:CG": -7e-05, "LYS:N": -0.0001, "LYS:NZ": 0.0,
    "LYS:O": 0.00082, "MET:CA": -0.00321, "MET:CB": -0.00133, "MET:CE": 0.00087, "MET:CG": 0.00103, "MET:O": 0.00028, "MET:SD": -0.00044,
    "MSE:CE": 0.00151, "MSE:CG": -0.0032, "MSE:SE": 0.00044, "PHE:CA": 0.00027, "PHE:CB": 0.00044, "PHE:CD1": 0.00099, "PHE:CD2": 0.00096,
    "PHE:CE1": 0.00155, "PHE:CE2": 0.00118, "PHE:CG": -0.00095, "PHE:CZ": 0.00122, "PHE:N": -0.00097, "PHE:O": 0.00034, "PRO:CA": -7e-05, "PRO:CB": 5e-05,
    "PRO:CD": 0.00021, "PRO:CG": 0.00033, "PRO:O": 0.00082, "SER:C": -0.00181, "SER:CA": -0.00063, "SER:CB": 0.00051, "SER:N": -0.00033, "SER:O": 0.00062,
    "SER:OG": -0.0004, "THR:CA": -0.00104, "THR:CB": 0.00012, "THR:CG2": 0.00028, "THR:N": -0.00104, "THR:O": 0.00073, "THR:OG1": 0.0003,
    "TRP:CB": -0.00027, "TRP:CD1": 0.00177, "TRP:CE2": 0.00149, "TRP:CE3": 0.00097, "TRP:CH2": 0.00079, "TRP:CZ2": 0.00177, "TRP:CZ3": 0.00259,
    "TRP:NE1": 0.0, "TRP:O": 0.00091, "TYR:CA": -0.00231, "TYR:CB": 0.0008, "TYR:CD1": 0.00106, "TYR:CD2": 0.00085, "TYR:CE1": 0.00281,
    "TYR:CE2": 0.00135, "TYR:CG": 0.00017, "TYR:CZ": 0.00104, "TYR:N": 0.00126, "TYR:O": 0.00069, "TYR:OH": 0.0001, "VAL:CA": -0.00093,
    "VAL:CB": -0.00067, "VAL:CG1": 0.00037, "VAL:CG2": 0.0004, "VAL:N": 0.00046, "VAL:O": 0.00084, "het:HAL:CL": -0.076, "het:HAL:I": 0.01755,
    "het:MET:CA": -0.05242, "het:MET:CD": 0.01752, "het:MET:CU": 0.01485, "het:MET:FE": 0.0084, "het:MET:HG": -0.04835, "het:MET:K": -0.35487,
    "het:MET:MG": 0.01092, "het:MET:MN": 0.05046, "het:MET:NA": -0.00257,
}
TYPED_RESIDUES = [
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "MSE",
    "A", "G", "C", "U", "DA", "DG", "DC", "DT", "DU",
]
TYPED_NUCLEOTIDES = ["A", "G", "C", "U", "DA", "DG", "DC", "DT", "DU"]
POLAR_SP2_CARBONS = ["ASN:CG", "GLN:CD", "ASP:CG", "GLU:CD", "ARG:CZ"]
PHOSPHATE_OXYGENS = ["OP1", "OP2", "OP3", "O1P", "O2P", "O3P", "O1A", "O2A", "O3A", "O1B", "O2B", "O3B", "O1G", "O2G", "O3G"]
ION_RESIDUES = ["SO4", "PO4", "PO3", "VO4", "WO4", "NO3", "CO3", "ACT", "FMT", "OXL", "CIT"]
HALOGENS = ["F", "CL", "BR", "I"]
SOLVATION_METALS = ["FE", "MG", "CA", "CU", "MN", "NI", "CO", "MO", "W", "CD", "HG", "NA", "K", "LI", "SR", "BA", "RB", "CS"]

# Hydrogen bonds: D donates, A accepts, DA does both.
BOND_ROLES = {
    "ARG:NE": "D", "ARG:NH1": "D", "ARG:NH2": "D", "LYS:NZ": "D", "HIS:ND1": "DA", "HIS:NE2": "DA", "ASN:ND2": "D", "ASN:OD1": "A", "GLN:NE2": "D",
    "GLN:OE1": "A", "ASP:OD1": "A", "ASP:OD2": "A", "GLU:OE1": "A", "GLU:OE2": "A", "SER:OG": "DA", "THR:OG1": "DA", "TYR:OH": "DA", "TRP:NE1": "D",
    "CYS:SG": "DA", "MET:SD": "A", "MSE:SE": "A",
}
BASE_ROLES = {
    "A:N6": "D", "A:N1": "A", "A:N3": "A", "A:N7": "A", "G:N1": "D", "G:N2": "D", "G:O6": "A", "G:N3": "A", "G:N7": "A", "C:N4": "D", "C:O2": "A",
    "C:N3": "A", "T:N3": "D", "T:O2": "A", "T:O4": "A", "U:N3": "D", "U:O2": "A", "U:O4": "A",
}
SUGAR_ROLES = {"OP1": "A", "OP2": "A", "OP3": "A", "O1P": "A", "O2P": "A", "O3P": "A", "O3'": "A", "O5'": "A", "O4'": "A", "O2'": "DA"}
DONOR_HYDROGENS = {
    "ARG:NE": 1, "ARG:NH1": 2, "ARG:NH2": 2, "LYS:NZ": 3, "HIS:ND1": 1, "HIS:NE2": 1, "ASN:ND2": 2, "GLN:NE2": 2, "SER:OG": 1, "THR:OG1": 1, "TYR:OH": 1,
    "TRP:NE1": 1, "CYS:SG": 1,
}
BASE_HYDROGENS = {"A:N6": 2, "G:N1": 1, "G:N2": 2, "C:N4": 2, "T:N3": 1, "U:N3": 1}
SALT_CHARGES = {
    "ARG:NE": 1, "ARG:NH1": 1, "ARG:NH2": 1, "LYS:NZ": 1, "HIS:ND1": 1, "HIS:NE2": 1, "ASP:OD1": -1, "ASP:OD2": -1, "GLU:OE1": -1, "GLU:OE2": -1,
}

# Classes of contacts.
CHARGED_ATOMS = {
    "ARG:NH1": 1, "ARG:NH2": 1, "ARG:CZ": 1, "LYS:NZ": 1, "HIS:ND1": 1, "HIS:NE2": 1, "ASP:OD1": -1, "ASP:OD2": -1, "GLU:OE1": -1, "GLU:OE2": -1,
}
MAP_SALT_CATIONS = ["LYS:NZ", "ARG:NH1", "ARG:NH2"]
MAP_SALT_ANIONS = ["ASP:OD1", "ASP:OD2", "GLU:OE1", "GLU:OE2"]
MAP_SALT_NUCLEOTIDES = ["A", "U", "G", "C", "T", "DA", "DG", "DC", "DT", "DU", "PSU"]
MAP_SALT_PHOSPHATES = ["OP1", "OP2", "O1P", "O2P"]
BARE_CARBONS = ["ASP:CG", "GLU:CD", "ASN:CG", "GLN:CD", "ARG:CZ", "TYR:CG", "TYR:CZ", "PHE:CG", "TRP:CG", "TRP:CD2", "TRP:CE2", "HIS:CG"]
BARE_BASE_CARBONS = ["A:C4", "A:C5", "A:C6", "G:C2", "G:C4", "G:C5", "G:C6", "C:C2", "C:C4", "T:C2", "T:C4", "T:C5", "U:C2", "U:C4"]
RING_ATOMS = [
    ("PHE", ["CG", "CD1", "CD2", "CE1", "CE2", "CZ"]),
    ("TYR", ["CG", "CD1", "CD2", "CE1", "CE2", "CZ"]),
    ("TRP", ["CG", "CD1", "CD2", "CE2", "CE3", "CZ2", "CZ3", "CH2", "NE1"]),
    ("HIS", ["CG", "ND1", "CD2", "CE1", "NE2"]),
    ("A", ["N1", "C2", "N3", "C4", "C5", "C6"]),
    ("G", ["N1", "C2", "N3", "C4", "C5", "C6", "N7", "C8", "N9"]),
    ("C", ["N1", "C2", "N3", "C4", "C5", "C6"]),
    ("T", ["N1", "C2", "N3", "C4", "C5", "C6"]),
    ("U", ["N1", "C2", "N3", "C4", "C5", "C6"]),
    ("DA", ["N1", "C2", "N3", "C4", "C5", "C6"]),
    ("DG", ["N1", "C2", "N3", "C4", "C5", "C6", "N7", "C8", "N9"]),
    ("DC", ["N1", "C2", "N3", "C4", "C5", "C6"]),
    ("DT", ["N1", "C2", "N3", "C4", "C5", "C6"]),
    ("DU", ["N1", "C2", "N3", "C4", "C5", "C6"]),
]
RING_GROUPS = [
    ("PHE", ["CG", "CD1", "CD2", "CE1", "CE2", "CZ"]),
    ("TYR", ["CG", "CD1", "CD2", "CE1", "CE2", "CZ"]),
    ("HIS", ["CG", "ND1", "CD2", "CE1", "NE2"]),
    ("TRP", ["CG", "CD1", "NE1", "CE2", "CD2"]),
    ("TRP", ["CD2", "CE2", "CZ2", "CH2", "CZ3", "CE3"]),
]
PYRIMIDINE_RING, IMIDAZOLE_RING = ["N1", "C2", "N3", "C4", "C5", "C6"], ["C4", "C5", "N7", "C8", "N9"]
CONTACT_METALS = ["FE", "ZN", "MG", "CA", "CU", "MN", "NI", "CO", "MO", "W", "CD", "HG", "NA", "K"]
POLAR_ELEMENTS = ["N", "O", "S", "F", "CL", "BR", "I"]
POLAR_NAMES = ["OP1", "OP2", "O1P", "O2P", "P"]

# Atomic masses in daltons.
MASSES = {
    "H": 1.008, "D": 2.014, "HE": 4.003, "LI": 6.94, "BE": 9.012, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "NE": 20.18,
    "NA": 22.99, "MG": 24.305, "AL": 26.982, "SI": 28.085, "P": 30.974, "S": 32.06, "CL": 35.45, "AR": 39.948, "K": 39.098, "CA": 40.078, "SC": 44.956,
    "TI": 47.867, "V": 50.942, "CR": 51.996, "MN": 54.938, "FE": 55.845, "CO": 58.933, "NI": 58.693, "CU": 63.546, "ZN": 65.38, "GA": 69.723, "GE": 72.63,
    "AS": 74.922, "SE": 78.97, "BR": 79.904, "KR": 83.798, "RB": 85.468, "SR": 87.62, "Y": 88.906, "ZR": 91.224, "NB": 92.906, "MO": 95.95, "RU": 101.07,
    "RH": 102.906, "PD": 106.42, "AG": 107.868, "CD": 112.414, "IN": 114.818, "SN": 118.71, "SB": 121.76, "TE": 127.6, "I": 126.904, "XE": 131.293,
    "CS": 132.905, "BA": 137.327, "LA": 138.905, "CE": 140.116, "PR": 140.908, "ND": 144.242, "SM": 150.36, "EU": 151.964, "GD": 157.25, "TB": 158.925,
    "DY": 162.5, "HO": 164.93, "ER": 167.259, "TM": 168.934, "YB": 173.045, "LU": 174.967, "HF": 178.486, "TA": 180.948, "W": 183.84, "RE": 186.207,
    "OS": 190.23, "IR": 192.217, "PT": 195.084, "AU": 196.967, "HG": 200.592, "TL": 204.38, "PB": 207.2, "BI": 208.98, "TH": 232.038, "U": 238.029,
}
OTHER_MASS = 12.011

# Energies in kcal/mol, and the fitted constants of the scores.
E_HYDROGEN_BOND, E_SALT_BRIDGE, E_DISULFIDE = -0.444037, -0.150028, -4.0
P_VALUE_SCALE = 0.46
CSS_CONSTANT, CSS_ENERGY, CSS_LOG_AREA = -6.9088, -0.1699, 0.8485
ENTROPY_LOG_TERM = 6.9298
GAS_CONSTANT, TEMPERATURE = 8.314462618 / 4184.0, 298.15

# --- lookups -------------------------------------------------------------------------------------------------------


def bases(of: dict) -> dict:
    """Entries of bases, for the bare name and for its D and R forms."""
    return {prefix + k: v for k, v in of.items() for prefix in ("", "D", "R")}


def ring_groups() -> list[tuple[str, list[str]]]:
    """(residue, atoms) of every ring; purines have two. Where rings share atoms the later one counts."""
    out = list(RING_GROUPS)
    for base in "AGCTU":
        for p in ("", "D", "R"):
            out.append((p + base, PYRIMIDINE_RING))
            if base in "AG":
                out.append((p + base, IMIDAZOLE_RING))
    return out


def contact_radius_rule() -> tuple[dict[str, float], dict[str, float]]:
    """Radii by element, and by first letter for elements not listed (the first listed with that letter)."""
    letters: dict[str, float] = {}
    for k, v in CONTACT_RADII.items():
        letters.setdefault(k[0], v)
    return CONTACT_RADII, letters

"""A seeded synthetic hospital: a phrase in the note says which codes the admission has."""

import random

PHRASES = {
    "I10": "longstanding high blood pressure treated with lisinopril",
    "E785": "elevated cholesterol managed with a statin",
    "E119": "sugar disease controlled by metformin",
    "N179": "acute kidney injury with rising creatinine",
    "I509": "heart failure with fluid overload and diuresis",
    "J449": "obstructive lung disease on inhalers",
    "F329": "low mood treated with sertraline",
    "K219": "acid reflux on omeprazole",
}


def make(n_patients=60, seed=0, pad=120):
    rng = random.Random(seed)
    notes, diagnoses, admissions, patients = [], [], [], []
    hadm = 1000
    for subject in range(1, n_patients + 1):
        patients.append((subject, rng.choice("FM"), rng.randint(40, 89), 2150, "2014 - 2016", None))
        for _ in range(rng.randint(1, 3)):
            hadm += 1
            codes = rng.sample(sorted(PHRASES), rng.randint(2, 5))
            for i, code in enumerate(codes, 1):
                diagnoses.append((subject, hadm, i, code, 10))
            story = " ".join(f"The patient has {PHRASES[c]}." for c in codes)
            filler = " ".join(rng.choice(["seen", "today", "stable", "plan", "ward"]) for _ in range(pad))
            text = f'Mr. ___ was admitted.\n{story}\nHe said "fine".\n{filler}'
            notes.append((f"{hadm}-DS-1", subject, hadm, "DS", 1, "2150-01-05 10:00:00", "2150-01-06 00:00:00", text))
            admissions.append((
                subject, hadm, "2150-01-01 08:00:00", "2150-01-05 08:00:00", "", "EW EMER.", "P1", "ER",
                "HOME", "Medicare", "English", "SINGLE", "WHITE", "", "", 0,
            ))
    return notes, diagnoses, admissions, patients


HEADERS = {
    "notes": "note_id,subject_id,hadm_id,note_type,note_seq,charttime,storetime,text".split(","),
    "diagnoses": "subject_id,hadm_id,seq_num,icd_code,icd_version".split(","),
    "admissions": (
        "subject_id,hadm_id,admittime,dischtime,deathtime,admission_type,admit_provider_id,"
        "admission_location,discharge_location,insurance,language,marital_status,race,edregtime,"
        "edouttime,hospital_expire_flag"
    ).split(","),
    "patients": "subject_id,gender,anchor_age,anchor_year,anchor_year_group,dod".split(","),
}
